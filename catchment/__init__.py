"""Accessibility, evidence and reference-data operators on Spark DataFrames."""
