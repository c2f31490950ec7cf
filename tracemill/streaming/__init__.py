"""Structured Streaming forms of the parsing and session operators."""
