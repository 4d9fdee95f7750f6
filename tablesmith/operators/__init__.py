"""Table operators: each takes DataFrames and returns lazy DataFrames."""
