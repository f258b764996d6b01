"""marlow: evidence retrieval, evaluation and corpus preparation on Spark."""
