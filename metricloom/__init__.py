"""OpenTelemetry metrics analytics as PySpark DataFrame operations."""
