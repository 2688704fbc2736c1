"""tickweave: DataFrame operators for market and event time series on Spark."""
