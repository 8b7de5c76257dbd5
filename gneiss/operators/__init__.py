"""Operators over DataFrames: vector search, sets, ranked sets, sorting, counters."""
