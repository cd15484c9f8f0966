"""Retrieval analytics on Spark: DataFrame and SQL operators over document corpora."""
