"""Multi-head retrieval and corpus processing on Spark."""
