"""Detector-evaluation and dataset-curation operators on Spark DataFrames."""
