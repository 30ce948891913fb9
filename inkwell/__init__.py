"""Inkwell: writing-style analytics on Spark DataFrames."""
