"""cohortlens: clinical evidence and cohort analytics as Spark DataFrame jobs."""
