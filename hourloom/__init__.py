"""hourloom: a Spark-native engine that turns raw sensor tables into
leakage-safe, model-ready forecasting windows and evaluates forecasts."""

__version__ = "0.1.0"
