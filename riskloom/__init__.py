"""Risk-model analytics as Spark jobs."""
