"""archloom: web-archive and training-corpus operators on Spark DataFrames."""
