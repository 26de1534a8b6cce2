"""Column functions, and user functions for Spark SQL."""
