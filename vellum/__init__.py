"""Paged-document ingestion, retrieval and grounded-answer operators as Spark plans."""
