"""silkmill: web-corpus analytics on Spark DataFrames."""
