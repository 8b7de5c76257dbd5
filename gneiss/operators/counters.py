"""Counters, approximate distinct counts and bits over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a sketch.
HLL_BITS = 14


def pfadd(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """PFADD: a sketch for each key."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, HLL_BITS).alias("sketch"))


def pfmerge(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """PFMERGE: one sketch of all, or for each key."""
    return (sketches.groupBy(*keys) if keys else sketches).agg(F.hll_union_agg("sketch").alias("sketch"))


def pfcount(sketches: DataFrame) -> DataFrame:
    """PFCOUNT: each sketch's estimate n; of several keys merge them first."""
    return sketches.select(*(c for c in sketches.columns if c != "sketch"), F.hll_sketch_estimate("sketch").alias("n"))


def bitop(df: DataFrame, keys: list[str], column: str, op: str) -> DataFrame:
    """BITOP AND, OR, XOR over the integers of a group."""
    own = {"and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}[op.lower()](column).alias("bits")
    return df.groupBy(*keys).agg(own) if keys else df.agg(own)


def bitcount(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """BITCOUNT: set bits of a group's integers."""
    own = F.sum(F.bit_count(column)).cast("long").alias("n")
    return df.groupBy(*keys).agg(own) if keys else df.agg(own)


def incr(df: DataFrame, keys: list[str], by: str | Column = None, start: DataFrame | None = None) -> DataFrame:
    """INCR, DECR, INCRBY, INCRBYFLOAT, HINCRBY, HINCRBYFLOAT: each key's value after all increments; a whole number
    that leaves 64 bits is an error. start: (keys, value) before."""
    step = F.lit(1).cast("long") if by is None else F.col(by) if isinstance(by, str) else by
    own = df.select(*keys, step.alias("value"))
    if start is not None:
        own = own.union(start.select(*keys, "value"))
    return own.groupBy(*keys).agg(F.sum("value").alias("value"))


def lengths(df: DataFrame, keys: list[str]) -> DataFrame:
    """LLEN, HLEN, XLEN: rows of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))
