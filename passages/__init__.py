"""Labelling, retrieval and evaluation of long ordered sequences, on Spark DataFrames."""
