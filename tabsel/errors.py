"""What can go wrong, by who can mend it."""


class TabselError(Exception):
    """Base of all errors raised on purpose."""


class InputError(TabselError):
    """A path, file or frame that can't be used."""


class SchemaError(TabselError):
    """Data that don't have the columns, types or values that are needed."""


class ConfigError(TabselError):
    """Settings that contradict each other or the task."""


class FitFailedError(TabselError):
    """No candidate could be fitted."""


class BudgetExhausted(FitFailedError):
    """The budget ended before any candidate was done."""


class IntegrityError(TabselError):
    """An artifact that isn't what its manifest says."""


class UnsupportedModel(TabselError):
    """A model that the portable format can't express."""
