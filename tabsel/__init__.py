"""tabsel: trustworthy model selection on tabular data, on Spark."""

__version__ = "0.1.0"
