"""tidemark: bounded telemetry analytics as Spark DataFrame programs."""
