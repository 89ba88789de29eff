"""bundlespark.plans."""
