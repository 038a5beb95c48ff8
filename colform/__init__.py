"""colform: profiling, compact columnar forms, relations and change sets on Spark DataFrames."""
