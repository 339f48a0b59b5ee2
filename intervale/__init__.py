"""Interval search, enrichment and table operators on Spark DataFrames."""
