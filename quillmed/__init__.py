"""Clinical-results and knowledge analytics as Spark DataFrame jobs."""
