"""Retrieval, extraction and change tracking over document corpora as Spark plans."""
