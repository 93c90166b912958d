"""Episode-audit analytics on Spark."""
