"""Reference-database curation and corpus preparation on Spark DataFrames."""
