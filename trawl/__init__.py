"""trawl: search and retrieval over collections of semi-structured documents, on Spark DataFrames."""
