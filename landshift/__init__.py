"""Municipal change analytics as Spark DataFrame and Structured Streaming jobs."""
