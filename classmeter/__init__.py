"""Learning analytics as Spark DataFrame jobs."""
