"""Article preparation, ingest and hybrid search as Spark jobs."""
