"""Operators for training-data pipelines over the tables of documents, labels, benchmark items and vectors."""
