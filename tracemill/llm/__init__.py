"""Operators of a training-data pipeline, each on whole DataFrames of documents, pages or messages."""
