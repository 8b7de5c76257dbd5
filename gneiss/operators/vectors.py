"""Nearest neighbours: exact by default, and by cells of an inverted file where an approximate answer will do."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that one pass over the rows answers.
QUERIES_AT_ONCE = 1024
#: Rows of a task of a join of rows with a table of queries.
ROWS_AT_ONCE = 1 << 17


def estimates(rows: np.ndarray, queries: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(queries x rows, the most that a query's row may be wrong by): squared Euclidean distance, by norms and one matrix
    product, or one less the inner product."""
    product = queries @ rows.T
    a, b = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", rows, rows)
    scale = 4 * (rows.shape[1] + 4) * np.finfo(float).eps * (a + b.max(initial=0) + 1)
    return (1.0 - product if metric == "ip" else a[:, None] + b[None, :] - 2 * product), scale


def exactly(rows: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """The distances to one vector in double precision, rounded to 12 decimals, so that equal vectors tie whatever order
    the sums were taken in."""
    if metric == "ip":
        return np.round(1.0 - np.einsum("ij,j->i", rows, query), 12) + 0.0
    return np.round(np.einsum("ij,ij->i", rows - query, rows - query), 12)


def nearest_rows(rows: np.ndarray, ties: np.ndarray, queries: np.ndarray, k: int, metric: str, allowed: np.ndarray | None = None):
    """For each query (places of its k nearest rows, nearest first and then by ties; distances). Estimates say which rows
    may be among them, whose distances are then computed anew. allowed: queries x rows."""
    if not len(rows):
        return [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
    near, wrong = estimates(rows, queries, metric)
    if allowed is not None:
        near[~allowed] = np.inf
    out = []
    for q, own in enumerate(near):
        at = np.arange(len(rows))
        if len(rows) > k:
            at = np.flatnonzero(own <= np.partition(own, k - 1)[k - 1] + 2 * wrong[q] + 1e-12)
        if allowed is not None:
            at = at[allowed[q][at]]
        d = exactly(rows[at], queries[q], metric)
        order = np.lexsort((ties[at], d))[:k]
        out.append((at[order], d[order]))
    return out


def matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of this size, their vectors). Others are not searched."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), -1))
    ok = np.flatnonzero(lengths == size)
    if len(ok) < len(vectors):
        vectors = vectors.take(pa.array(ok))
    return ok, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), size)


def distance(column: str | Column, query: list[float], metric: str = "l2") -> Column:
    """The distance of an array column to one vector as a SQL expression; null if the lengths differ."""
    c = F.col(column) if isinstance(column, str) else column
    c, q = c.cast("array<double>"), F.array(*(F.lit(float(x)) for x in query))
    step = (lambda x, y: x * y) if metric == "ip" else (lambda x, y: (x - y) * (x - y))
    total = F.aggregate(F.zip_with(c, q, step), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(c) == len(query), 1.0 - total if metric == "ip" else total)


def scored(df: DataFrame, vector: str, queries: list[tuple[object, list[float]]], k: int, metric: str, tie: str, probed: np.ndarray | None = None) -> DataFrame:
    """The k nearest rows of each Arrow batch to each query, with `qid` and `distance`: what is left to merge is at
    most k rows a batch and query. probed: which values of the column `cell` are for which query, all without."""
    sizes = {len(q) for _, q in queries}
    if len(sizes) != 1:
        raise ValueError("queries have one and the same length")
    ids, points, size = [q for q, _ in queries], np.array([v for _, v in queries], np.float64), sizes.pop()
    names = df.columns
    schema = T.StructType([T.StructField("qid", T.LongType()), *df.schema.fields, T.StructField("distance", T.DoubleType())])

    def nearest(batches):
        for batch in batches:
            ok, rows = matrix(batch[vector], size)
            if not len(ok):
                continue
            allowed = None if probed is None else probed[:, batch["cell"].to_numpy()[ok]]
            ties = batch[tie].take(pa.array(ok)).to_numpy(zero_copy_only=False)
            found = nearest_rows(rows, ties, points, k, metric, allowed)
            at, d = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            own = batch.take(pa.array(ok[at]))
            yield pa.record_batch([pa.array(np.repeat(np.array(ids, np.int64), [len(f[0]) for f in found])), *own.columns, pa.array(d)], names=["qid", *names, "distance"])

    return df.mapInArrow(nearest, schema)


def ann(df: DataFrame, query: list[float], k: int, vector: str = "embedding", metric: str = "l2", tie: str = "vec_id") -> DataFrame:
    """The k rows nearest to the query, nearest first, with `distance` as last column; ties go by `tie`. Fewer rows
    than k give fewer. Rows without a vector of the query's length are passed over. A partition sends k rows on."""
    if k <= 0:
        raise ValueError("k is positive")
    return scored(df, vector, [(0, list(query))], k, metric, tie).drop("qid").orderBy("distance", tie).limit(k)


def batch_ann(df: DataFrame, queries: list[tuple[int, list[float]]] | DataFrame, k: int, vector: str = "embedding", metric: str = "l2", tie: str = "vec_id", probed: np.ndarray | None = None) -> DataFrame:
    """For each query (qid, vector) its k nearest rows: qid, rank from 1, the row, distance.

    Queries are a list, of which each pass over the rows answers QUERIES_AT_ONCE, or a table (qid, the vector column) of any
    size. Only k best of a query from each batch or task are merged."""
    if isinstance(queries, DataFrame):
        out = joined(df, queries, k, vector, metric, tie)
        best = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", tie))).where(F.col("rank") <= k)
        return best.select("qid", "rank", *df.columns, "distance")
    if not queries:
        raise ValueError("there is a query at least")
    parts = [scored(df, vector, queries[a : a + QUERIES_AT_ONCE], k, metric, tie, None if probed is None else probed[a : a + QUERIES_AT_ONCE]) for a in range(0, len(queries), QUERIES_AT_ONCE)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    order = Window.partitionBy("qid").orderBy("distance", tie)
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("qid", "rank", *df.columns, "distance")


def joined(df: DataFrame, queries: DataFrame, k: int, vector: str, metric: str, tie: str) -> DataFrame:
    """The k nearest rows of each group of rows to each query of a table (qid, vector): rows and queries are dealt into
    groups by a hash, as many as their counts ask for, and each pair of groups is one task. So rows are copied once for each
    QUERIES_AT_ONCE queries, and neither side is ever collected or broadcast."""
    from math import ceil

    names, q = df.columns, queries.select(F.col("qid").cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("_q"))
    across, down = max(1, ceil(queries.count() / QUERIES_AT_ONCE)), max(1, ceil(df.count() / ROWS_AT_ONCE))
    grid = lambda c, n: F.pmod(F.xxhash64(F.lit("grid"), c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = df.select("*", grid(tie, down).alias("_r")).select("*", every(across).alias("_c"))
    right = q.select("*", grid("qid", across).alias("_c")).select("*", every(down).alias("_r"))
    schema = T.StructType([T.StructField("qid", T.LongType()), *df.schema.fields, T.StructField("distance", T.DoubleType())])

    def nearest(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows, parts = rows.combine_chunks(), []
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(asked["_q"]), 0))
        for size in np.unique(lengths[lengths > 0]).tolist():
            mine = asked.filter(pa.array(lengths == size))
            points = mine["_q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(mine), size)
            whole = rows[vector].combine_chunks() if rows[vector].num_chunks != 1 else rows[vector].chunk(0)
            ok, own = matrix(whole, size)
            ties = rows[tie].take(pa.array(ok)).to_numpy()
            found = nearest_rows(own, ties, points, k, metric)
            at, d = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            taken = rows.select(names).take(pa.array(ok[at]))
            parts.append(pa.table([np.repeat(mine["qid"].to_numpy(), [len(f[0]) for f in found]), *taken.columns, d], names=["qid", *names, "distance"]))
        empty = pa.table([pa.array([], pa.int64()), *rows.select(names).slice(0, 0).columns, pa.array([], pa.float64())], names=["qid", *names, "distance"])
        return pa.concat_tables([empty, *parts])

    return left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInArrow(nearest, schema)


def merge_top_k(parts: list[DataFrame], k: int, tie: str | None = None) -> DataFrame:
    """The k nearest of several results that have a `distance`: concatenated, sorted, cut."""
    if not parts:
        raise ValueError("there is nothing to merge")
    if any("distance" not in p.columns for p in parts):
        raise ValueError("a result to merge has a distance column")
    return union_all(parts).orderBy("distance", *([tie] if tie else [])).limit(k)


def merge_batch_top_k(parts: list[DataFrame], k: int, tie: str) -> DataFrame:
    """The same for each qid."""
    order = Window.partitionBy("qid").orderBy("distance", tie)
    return union_all(parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of results that have one and the same schema."""
    first = parts[0]
    for p in parts[1:]:
        if [(f.name, f.dataType) for f in p.schema] != [(f.name, f.dataType) for f in first.schema]:
            raise ValueError("the results have different schemas")
        first = first.union(p)
    return first


class CellIndex:
    """An inverted file: each row in the cell of the nearest of some centres, and the nearest cells searched exactly.

    Centres come from `sample` rows at most, taken by a hash of the row's tie column (documented bound: it holds centres only;
    every row is assigned). As a partition column of a written table, `cell` makes a search read the probed cells alone. A
    written index takes more rows (`add`) and is opened again by `open`, with the centres it had. An index of no rows finds
    nothing, and takes its centres from the first rows that are added.
    """

    def __init__(self, df: DataFrame, cells: int = 32, vector: str = "embedding", tie: str = "vec_id", metric: str = "l2", sample: int = 20_000, rounds: int = 10, seed: int = 0):
        self.vector, self.tie, self.metric, self.path = vector, tie, metric, None
        self.how = {"cells": cells, "sample": sample, "rounds": rounds, "seed": seed}
        self.fit(df)
        self.rows = self.assign(df)

    def fit(self, df: DataFrame) -> None:
        own = [r[0] for r in df.where(F.size(self.vector) > 0).orderBy(F.xxhash64(self.tie), self.tie).limit(self.how["sample"]).select(self.vector).collect()]
        own = [v for v in own if len(v) == len(own[0])]
        x = np.array(own, np.float64).reshape(len(own), -1 if own else 0)
        rng = np.random.default_rng(self.how["seed"])
        c = x[rng.choice(len(x), min(self.how["cells"], len(x)), replace=False)] if len(x) else x
        for _ in range(self.how["rounds"] if len(x) else 0):
            near = estimates(x, c, "l2")[0].argmin(axis=0)
            c = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        self.centres, self.sample, self.needed = c, x, {}

    def assign(self, df: DataFrame) -> DataFrame:
        """df with `cell`, -1 for rows without a vector of the centres' length."""
        vector, centres, names = self.vector, self.centres, df.columns

        def cell(batches):
            for batch in batches:
                out = np.full(len(batch), -1, np.int32)
                ok, rows = matrix(batch[vector], centres.shape[1]) if len(centres) else (np.zeros(0, np.int64), None)
                if len(ok):
                    out[ok] = estimates(rows, centres, "l2")[0].argmin(axis=0)
                yield pa.record_batch([*batch.columns, pa.array(out)], names=[*names, "cell"])

        return df.mapInArrow(cell, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())]))

    def write(self, path: str) -> CellIndex:
        """The rows by cell, and what the index knows, under path; searches then read the cells they probe."""
        spark, self.path = self.rows.sparkSession, path.rstrip("/")
        self.rows.write.partitionBy("cell").parquet(f"{self.path}/rows")
        self._write_state()
        self.rows = spark.read.schema(self.rows.schema).parquet(f"{self.path}/rows")
        return self

    def _write_state(self) -> None:
        state = json.dumps({"vector": self.vector, "tie": self.tie, "metric": self.metric, "how": self.how, "schema": self.rows.schema.json()})
        spark = self.rows.sparkSession
        spark.createDataFrame([(state, self.centres.tolist(), self.sample.tolist())], "state string, centres array<array<double>>, sample array<array<double>>").write.mode("overwrite").parquet(f"{self.path}/index")

    @classmethod
    def open(cls, spark, path: str) -> CellIndex:
        """A written index as it was, without a look at its rows."""
        own, row = cls.__new__(cls), spark.read.parquet(f"{path.rstrip('/')}/index").first()
        state = json.loads(row["state"])
        own.path, own.vector, own.tie, own.metric, own.how = path.rstrip("/"), state["vector"], state["tie"], state["metric"], state["how"]
        own.centres, own.sample = (np.array(row[x], np.float64).reshape(len(row[x]), -1 if row[x] else 0) for x in ("centres", "sample"))
        own.needed = {}
        own.rows = spark.read.schema(T.StructType.fromJson(json.loads(state["schema"]))).parquet(f"{own.path}/rows")
        return own

    def add(self, df: DataFrame) -> CellIndex:
        """More rows, found from now on. A written index appends them to its cells."""
        if not len(self.centres):
            self.fit(df)
        if self.path is None:
            self.rows = self.rows.union(self.assign(df))
            return self
        self.assign(df).write.partitionBy("cell").mode("append").parquet(f"{self.path}/rows")
        self._write_state()
        self.rows = df.sparkSession.read.schema(self.rows.schema).parquet(f"{self.path}/rows")
        return self

    def probes(self, query: list[float], n: int) -> list[int]:
        if not len(self.centres):
            return []
        return np.argsort(exactly(self.centres, np.array(query, np.float64), self.metric), kind="stable")[:n].tolist()

    def enough(self, k: int, least: float = 0.95, queries: int = 256) -> int:
        """The number of nearest cells that hold `least` of the k nearest neighbours of rows of the sample, the row itself
        aside. Neighbours in all rows are nearer than those in the sample, so these cells hold no less of them."""
        if not len(self.centres):
            return 0
        if k not in self.needed:
            x, c = self.sample, self.centres
            own = estimates(x, c, "l2")[0].argmin(axis=0)
            rows = min(k + 1, len(x))  # the row itself is one
            at = []
            for q in x[:queries]:
                near = np.argsort(exactly(x, q, self.metric), kind="stable")[:rows]
                near = near[(x[near] != q).any(axis=1)]
                rank = np.argsort(np.argsort(exactly(c, q, self.metric), kind="stable"), kind="stable")
                at.append(rank[own[near]])
            at = np.sort(np.concatenate(at))
            self.needed[k] = int(at[min(len(at) - 1, int(np.ceil(least * len(at))))]) + 1 if len(at) else len(c)
        return self.needed[k]

    def search(self, query: list[float], k: int, ef: int | None = None) -> DataFrame:
        """The k nearest rows of the nearest cells: as many as `enough` finds, or with ef
        max(k, ef) / k cells, 4 at least."""
        n = self.enough(k) if ef is None else max(4, -(-max(k, ef) // k))
        return ann(self.rows.where(F.col("cell").isin(self.probes(query, n))).drop("cell"), query, k, self.vector, self.metric, self.tie)

    def batch_search(self, queries: list[tuple[int, list[float]]], k: int, cells: int | None = None) -> DataFrame:
        """`search` for each query (qid, vector), with results as batch_ann has them. cells: how many to probe, if not as
        many as `enough` finds."""
        n, probed = self.enough(k) if cells is None else cells, np.zeros((len(queries), len(self.centres)), bool)
        for row, (_, point) in zip(probed, queries, strict=True):
            row[self.probes(point, n)] = True
        return batch_ann(self.rows.where("cell >= 0"), queries, k, self.vector, self.metric, self.tie, probed).drop("cell")


def recall(found: list[float], exact: list[float]) -> float:
    """The share of found distances that are no further than the furthest exact one."""
    return sum(d <= max(exact) + 1e-9 for d in found) / max(1, len(exact))
