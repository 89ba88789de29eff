"""bundlespark.sources."""
