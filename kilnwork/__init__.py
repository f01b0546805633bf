"""Kilnwork: catalogue linking, retrieval and evaluation on Spark DataFrames."""
