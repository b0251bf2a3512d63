"""kelpie: change-impact and CI-telemetry analytics as Spark DataFrame programs."""
