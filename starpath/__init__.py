"""starpath: store recommendation analytics as Spark DataFrame jobs."""
