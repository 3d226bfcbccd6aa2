"""Column functions: every function here takes and returns Spark columns."""
