"""Column functions that stay inside Spark expressions."""
