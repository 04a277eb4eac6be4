"""Program-graph analytics over Spark DataFrames."""
