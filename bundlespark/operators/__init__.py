"""bundlespark.operators."""
