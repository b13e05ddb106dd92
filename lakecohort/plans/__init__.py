"""Compiled plans: cohorts, analyses, the query API and the registry of queries."""
