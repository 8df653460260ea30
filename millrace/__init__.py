"""millrace: relational, streaming and text processing on Spark DataFrames."""
