"""bundlespark: knowledge bundles and text corpora as Spark DataFrames."""
