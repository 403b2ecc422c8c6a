"""Training-data operators: one module each, on Spark DataFrames."""
