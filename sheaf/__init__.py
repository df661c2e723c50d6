"""Document analytics on Spark: pages, transcripts, threads and citations as DataFrames."""
