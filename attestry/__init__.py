"""Attestry: compliance evidence and corpus preparation on Spark DataFrames."""
