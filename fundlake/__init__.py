"""Fund-portfolio analytics on Spark: ingest, incremental loads, derived views and reports."""
