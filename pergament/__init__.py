"""Document-record engine on Spark."""
