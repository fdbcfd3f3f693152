"""stockflow: warehouse stock snapshot analytics on Spark DataFrames."""
