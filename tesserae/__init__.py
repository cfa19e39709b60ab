"""Analytics over hierarchical collections of N-dimensional arrays, built on Spark DataFrames."""
