"""Operators for preparing language-model training text, all on Spark DataFrames."""
