"""ragtide: Spark-native analytics over retrieval runs, defense diagnostics and the corpora behind them."""

__version__ = "0.1.0"
