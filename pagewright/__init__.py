"""Page extraction and link-frontier analytics on Spark DataFrames."""
