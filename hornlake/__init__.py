"""Horn-rule quality over knowledge graphs, on Spark DataFrames."""
