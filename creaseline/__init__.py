"""Ball-by-ball match analytics as PySpark DataFrame and Structured Streaming jobs."""
