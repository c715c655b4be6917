"""Gated hybrid retrieval and corpus processing as Spark DataFrame operators."""
