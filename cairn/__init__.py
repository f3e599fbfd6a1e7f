"""Content-index and corpus operators on Spark DataFrames."""
