"""Orrery: catalogue retrieval, governance and measurement on Spark DataFrames."""
