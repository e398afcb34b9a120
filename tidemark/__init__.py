"""tidemark: event-time market analytics and document retrieval on Spark DataFrames."""
