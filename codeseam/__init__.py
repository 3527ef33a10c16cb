"""Code analytics on Spark."""
