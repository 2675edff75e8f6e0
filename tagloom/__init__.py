"""Tag readiness and evaluation on Spark DataFrames and Structured Streaming."""
