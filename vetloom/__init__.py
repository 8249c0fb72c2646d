"""Document extraction and vendor analytics on Spark."""
