"""Citation-integrity studies and text-corpus profiling on Spark DataFrames."""
