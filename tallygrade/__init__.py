"""Grading query answers at scale with Spark DataFrames."""
