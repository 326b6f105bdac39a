"""barspan: intraday panel features, walk-forward folds and forecast evaluation on PySpark."""

__version__ = "0.1.0"
