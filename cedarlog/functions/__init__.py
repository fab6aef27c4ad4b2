"""Column-level building blocks; all are built-in Spark expressions."""
