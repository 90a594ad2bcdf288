"""Property, hazard, census and incident analytics on Spark DataFrames."""
