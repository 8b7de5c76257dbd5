"""SORT: elements by themselves or by looked-up weights, with looked-up columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def looked_up(df: DataFrame, pattern: str, table: DataFrame, to: str, element: str) -> DataFrame:
    """Adds `to`: what table (key, value) or hash (key, field, value) has at the pattern with the element for `*`."""
    key, _, name = pattern.partition("->")
    before, _, after = key.partition("*")
    own = table.where(F.col("field") == name) if name else table
    own = own.select(F.col("key").alias("_key"), F.col("value").alias(to))
    return df.join(own, F.concat(F.lit(before), F.col(element).cast("string"), F.lit(after)) == F.col("_key"), "left").drop("_key")


def sort(df: DataFrame, element: str = "element", by: str | None = None, table: DataFrame | None = None, get: list[str] | None = None, desc: bool = False, alpha: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """The elements in order, or for each the values of the get patterns (`#` is the element), as get_0, get_1 ...

    Numbers by default, and an element that is none is an error; alpha sorts by bytes. Equal weights go by the
    element's bytes, also reversed by desc. A missing weight is 0 as a number and first by bytes. `by` without `*`
    keeps the elements as they come. A limit becomes a top-k, and what is looked up is joined to its rows only; joins
    keep no order, so the order by weight comes last.
    """
    weight, out = F.col(element), df
    if by is not None and "*" in by:
        out, weight = looked_up(out, by, table, "_weight", element), F.col("_weight")
    keys = []
    as_number = F.when(weight.isNull(), F.lit(0.0)).otherwise(weight.cast("double"))
    key = F.coalesce(weight.cast("string"), F.lit("")) if alpha else as_number
    if by is None or "*" in by:
        out = out.withColumn("_by", key)
        keys = [k.desc() if desc else k.asc() for k in (F.col("_by"), F.col(element).cast("string"))]
        if offset or count is not None:
            out = out.orderBy(*keys)
            out = out.offset(offset) if offset else out
            out = out if count is None else out.limit(count)
    names = []
    for k, pattern in enumerate(get or []):
        if pattern == "#":
            out = out.withColumn(f"get_{k}", F.col(element))
        else:
            out = looked_up(out, pattern, table, f"get_{k}", element)
        names.append(f"get_{k}")
    out = out.orderBy(*keys) if keys else out
    return out.select(element, *names)


def top_of_groups(df: DataFrame, keys: list[str], order: list[Column], k: int, to: str) -> DataFrame:
    """The first k rows of each group in an order, with their place from 1. Spark keeps k rows of a group at most before the
    shuffle."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(to) <= k)
