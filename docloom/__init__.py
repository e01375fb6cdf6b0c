"""docloom: document analytics on Spark DataFrames."""
