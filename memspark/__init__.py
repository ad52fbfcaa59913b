"""memspark: text-memory analytics as Spark DataFrame jobs."""
