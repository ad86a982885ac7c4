"""Document intelligence and translation-quality analytics on Spark DataFrames."""
