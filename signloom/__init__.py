"""Signloom: parallel-text analytics expressed on Spark DataFrames."""
