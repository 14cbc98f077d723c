"""Whole pipelines and the registered driver queries."""
