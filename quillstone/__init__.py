"""quillstone: text, conversation and array analytics on Spark DataFrames."""
