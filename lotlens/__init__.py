"""Property-record analytics as Spark DataFrame operators."""
