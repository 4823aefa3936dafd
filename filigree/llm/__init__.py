"""Operators of a training-data pipeline, written on Spark DataFrames."""
