"""bundlespark.functions."""
