"""Column functions over text and statistics, all built from Spark's own expressions."""
