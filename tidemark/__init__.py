"""Event and market analytics as Spark DataFrame, SQL and Structured Streaming operations."""
