"""Structured Streaming forms of row operators."""
