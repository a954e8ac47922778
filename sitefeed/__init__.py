"""Site content to feed pipeline on Spark DataFrames."""
