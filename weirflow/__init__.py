"""weirflow: keyed exchange operators and their metadata, expressed with Spark DataFrames."""
