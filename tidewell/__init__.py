"""Analytics over daily market series, and training-data operators, on Spark DataFrames."""
