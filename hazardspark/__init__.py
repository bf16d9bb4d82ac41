"""hazardspark: survival analysis on Spark DataFrames."""
