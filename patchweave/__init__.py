"""patchweave: software-vulnerability analytics on Spark DataFrames."""
