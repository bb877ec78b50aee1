"""siltstone: a corpus-analytics engine on Spark DataFrames, SQL and Structured Streaming."""
