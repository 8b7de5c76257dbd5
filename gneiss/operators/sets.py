"""Sets: DataFrames with a column `member`. Every operation is a shuffle on the member or less."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.common import numbered


def members(df: DataFrame, column: str = "member") -> DataFrame:
    """SMEMBERS: the distinct members."""
    return df.select(F.col(column).alias("member")).distinct()


def union(*sets: DataFrame) -> DataFrame:
    """SUNION."""
    return reduce(DataFrame.union, (s.select("member") for s in sets)).distinct()


def inter(*sets: DataFrame) -> DataFrame:
    """SINTER: the members of all sets; an empty set gives none. One grouping, however many sets there are."""
    tagged = reduce(DataFrame.union, (s.select("member", F.lit(k).alias("_set")) for k, s in enumerate(sets)))
    return tagged.groupBy("member").agg(F.countDistinct("_set").alias("n")).where(F.col("n") == len(sets)).select("member")


def inter_card(*sets: DataFrame, limit: int = 0) -> DataFrame:
    """SINTERCARD: (n), up to limit if that is over 0."""
    own = inter(*sets)
    return (own.limit(limit) if limit else own).agg(F.count("*").alias("n"))


def diff(first: DataFrame, *others: DataFrame) -> DataFrame:
    """SDIFF: the members of the first set that no other has."""
    own = members(first)
    return own.join(union(*others), "member", "left_anti") if others else own


def card(s: DataFrame) -> DataFrame:
    """SCARD: (n)."""
    return s.agg(F.count_distinct("member").alias("n"))


def is_member(s: DataFrame, asked: DataFrame) -> DataFrame:
    """SISMEMBER, SMISMEMBER: the asked members with is_member, 1 or 0."""
    marked = members(s).withColumn("_in", F.lit(1))
    return asked.join(marked, "member", "left").select(*asked.columns, F.coalesce("_in", F.lit(0)).alias("is_member"))


def add(s: DataFrame, more: DataFrame) -> DataFrame:
    """SADD."""
    return union(s, more)


def remove(s: DataFrame, gone: DataFrame) -> DataFrame:
    """SREM."""
    return diff(s, gone)


def move(source: DataFrame, to: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SMOVE: both sets after the move of the members that the source has."""
    going = members(moved).join(members(source), "member", "left_semi")
    return diff(source, going), union(to, going)


def random_members(s: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """SRANDMEMBER: n distinct members; for n under 0 the same number of draws, repeats allowed. The order is a hash of
    the member, so the same seed gives the same sample on any cluster."""
    own = members(s)
    if n < 0:
        return drawn(own, -n, seed)
    return own.orderBy(F.xxhash64(F.lit(seed), "member"), "member").limit(n)


def drawn(own: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws of rows with different members, repeats allowed: places drawn by a hash, joined to the members' places."""
    size = own.count()
    if not size:
        return own.limit(0)
    draws = own.sparkSession.range(n).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(size)).alias("_k"))
    return draws.join(numbered(own, [F.asc("member")], "_k"), "_k").select(own.columns)


def pop(s: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """SPOP: (popped, left)."""
    popped = random_members(s, n, seed)
    return popped, diff(s, popped)


def glob(pattern: str) -> str:
    """A regular expression for a pattern with *, ?, [a-c], [^a] and backslash escapes, over the whole text."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", k + 1)) > 0:
            inner = pattern[k + 1 : end]
            no = inner.startswith("^")
            out += "[" + "^" * no + "".join("\\" + x if not x.isalnum() and x != "-" else x for x in inner[no:]) + "]"
            k = end
        else:
            if c == "\\" and k + 1 < len(pattern):
                k += 1
                c = pattern[k]
            out += c if c.isalnum() or c == "_" else "\\" + c
        k += 1
    return f"(?s)^{out}$"


def matches(column: str | Column, pattern: str) -> Column:
    """SCAN, KEYS ... MATCH pattern."""
    return (F.col(column) if isinstance(column, str) else column).rlike(glob(pattern))
