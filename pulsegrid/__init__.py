"""Time-series telemetry analytics on PySpark."""
