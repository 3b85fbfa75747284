"""Network-traffic corpus jobs on Spark DataFrames."""
