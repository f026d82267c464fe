"""Similarity-network analytics expressed as Spark DataFrame jobs."""
