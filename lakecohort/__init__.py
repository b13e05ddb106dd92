"""Governed clinical-study analytics on Spark."""
