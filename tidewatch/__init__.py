"""Fleet telemetry analytics as DataFrame operators for Apache Spark."""
