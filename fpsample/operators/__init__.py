"""Sampling operators on DataFrames."""
