"""Play-count analytics and item-based recommendations as Spark DataFrame jobs."""
