"""Panel (entity by date) analytics on Spark DataFrames."""
