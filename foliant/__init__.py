"""foliant: document-image analytics on Spark DataFrames."""
