"""arcspark: graph analytics and network optimization on Spark DataFrames."""
