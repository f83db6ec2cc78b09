"""quern: corpus preparation and measurement as Spark DataFrame operations."""
