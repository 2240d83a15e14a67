"""Publication-monitoring analytics on Spark."""
