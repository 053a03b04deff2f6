"""Settings of a run, with their defaults and the checks between them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from .errors import ConfigError

SCHEMES = ("auto", "holdout", "kfold", "stratified", "group", "timeseries", "timeseries_period")


@dataclass(frozen=True)
class CVConfig:
    scheme: str = "auto"
    n_splits: int = 5
    n_test: int = 1
    n_es: int = 1
    purge: int = 0
    embargo: int = 0
    purge_delta: float | None = None
    embargo_delta: float | None = None
    period: str | None = None
    period_size: float | None = None
    step_periods: int | None = None
    max_train_periods: int | None = None
    max_train_size: int | None = None
    weighting: str = "pooled"
    calibrate: str = "off"
    selection: str = "raw"
    refinement_min_oof: int = 2000
    outer_holdout: float = 0.0

    def __post_init__(self) -> None:
        timed = self.scheme.startswith("timeseries")
        if self.scheme not in SCHEMES:
            raise ConfigError(f"scheme {self.scheme!r} is none of {SCHEMES}")
        if self.n_splits < 2 and self.scheme != "holdout":
            raise ConfigError("n_splits is below 2")
        if not timed and any((self.purge, self.embargo, self.purge_delta is not None, self.embargo_delta is not None, self.max_train_size, self.max_train_periods)):
            raise ConfigError("gaps and rolling windows are for time schemes")
        if self.purge and self.purge_delta is not None or self.embargo and self.embargo_delta is not None:
            raise ConfigError("a gap is counted in rows (or periods) or in time, not both")
        if (self.scheme == "timeseries_period") != (self.period is not None):
            raise ConfigError("period goes with scheme timeseries_period, and with no other")
        if self.max_train_periods is not None and self.scheme != "timeseries_period" or self.max_train_size is not None and self.scheme != "timeseries":
            raise ConfigError("the rolling window's unit doesn't suit the scheme")
        if not 0 <= self.outer_holdout < 1:
            raise ConfigError("outer_holdout is outside [0, 1)")
        if self.weighting == "period" and not timed:
            raise ConfigError("weighting by period needs a time scheme")


@dataclass(frozen=True)
class FEConfig:
    target_encoding: bool = False
    te_smoothing: float = 10.0
    frequency_encoding: bool = False
    intersections: bool = False
    max_pairs: int = 50
    report_date: str | None = None
    fit_on: str = "dev"


@dataclass(frozen=True)
class FSConfig:
    strategy: str = "importance"
    cutoff: str = "top_frac"
    top_k: int | None = None
    top_frac: float = 0.5
    min_features: int = 1
    n_probes: int = 3
    n_runs: int = 30
    null_percentile: float = 95.0
    null_block_size: int = 50
    seq_min_features: int = 1
    seq_patience: int = 2
    max_refits: int = 500
    compare: tuple[str, ...] = ()
    selection_holdout: float = 0.25

    def __post_init__(self) -> None:
        for other in self.compare:
            FSConfig(strategy=other)
        if not 0 < self.selection_holdout < 1:
            raise ConfigError("selection_holdout is outside (0, 1)")
        if self.strategy not in ("importance", "null_importance", "random_probe", "permutation", "sequential"):
            raise ConfigError(f"unknown strategy {self.strategy!r}")
        if not 0 < self.top_frac <= 1:
            raise ConfigError("top_frac is outside (0, 1]")


@dataclass(frozen=True)
class HPOConfig:
    n_trials: int = 50
    timeout_s: float | None = None
    inner_cv: int = 3
    models: tuple[str, ...] | None = None


@dataclass(frozen=True)
class EnsembleConfig:
    method: str = "caruana"
    size: int = 50
    n_bags: int = 20
    metric: str | None = None


@dataclass(frozen=True)
class BudgetConfig:
    time_budget_s: float | None = None
    n_trials: int | None = None
    memory_limit_mb: float | None = None


@dataclass(frozen=True)
class RunConfig:
    seed: int = 42
    alpha: float = 0.05
    n_boot: int = 1000
    significance: str = "bootstrap"
    run_mode: str = "full"
    cv: CVConfig = field(default_factory=CVConfig)
    fe: FEConfig = field(default_factory=FEConfig)
    fs: FSConfig | None = None
    hpo: HPOConfig | None = None
    ensemble: EnsembleConfig | None = None
    budget: BudgetConfig = field(default_factory=BudgetConfig)


PRESETS = {"fast": {"cv": CVConfig(n_splits=3)}, "balanced": {"ensemble": EnsembleConfig()}, "best": {"hpo": HPOConfig(), "ensemble": EnsembleConfig()}}


def preset(name: str, config: RunConfig | None = None) -> RunConfig:
    """The preset's parts, where the given settings are still the defaults."""
    if name not in PRESETS:
        raise ConfigError(f"preset {name!r} is none of {sorted(PRESETS)}")
    config, plain = config or RunConfig(), RunConfig()
    same = {f.name for f in fields(RunConfig) if getattr(config, f.name) == getattr(plain, f.name)}
    return replace(config, **{k: v for k, v in PRESETS[name].items() if k in same})
