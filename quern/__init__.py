"""Quern: a Spark-first engine for document ingestion, retrieval and corpus preparation."""
