"""Batch analytics over software-repository facts, expressed as Spark DataFrames."""
