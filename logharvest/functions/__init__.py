"""Column expressions. All of them are built-in Spark expressions (no UDF)."""
