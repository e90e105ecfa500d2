"""Panel-forecasting analytics as Spark DataFrame plans."""
