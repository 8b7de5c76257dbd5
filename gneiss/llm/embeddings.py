"""Embedding near-dedup: int8 tile products with error bounds, full precision only where the bound leaves it open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import SALTS, components, local_forest, look_up, n_parts, salt, small, staged

#: Vectors of one label that a task multiplies with as many others.
TILE = 2048


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; of a row as small or large as its squares can't be held, after a scaling that loses nothing."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, norms of what they stand for, norms of what they miss) of unit rows."""
    scale = np.abs(x).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    held = q * scale[:, None]
    return q, scale, np.linalg.norm(held, axis=1), np.linalg.norm(x - held, axis=1)


def judged_pairs(a, b, threshold: float, rows: int = 512):
    """(i, j, sure) of rows of two quantised sets whose cosine may reach the threshold, in parts; sure ones do for certain.

    With x = s q + e for each unit vector, x.y differs from the int8 product s_x s_y q_x.q_y by s_x q_x.e_y + e_x.y, so
    by no more than |s_x q_x| |e_y| + |e_x|. Products of int8 sum exactly in float32 up to 1,040 dimensions and in double
    beyond. The slack is far over what double precision can be wrong by.
    """
    (qa, sa, ha, ea), (qb, sb, _, eb) = a, b
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    qb = qb.astype(kind).T
    for k in range(0, len(qa), rows):
        to = slice(k, k + rows)
        product = (qa[to].astype(kind) @ qb).astype(np.float64) * sa[to, None] * sb[None, :]
        bound = ha[to, None] * eb[None, :] + ea[to, None]
        i, j = np.nonzero(product + bound >= threshold - 1e-9)
        yield i + k, j, product[i, j] - bound[i, j] >= threshold + 1e-7


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; of rows whose squares can't be held, of their unit rows."""
    with np.errstate(all="ignore"):
        out = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    bad = np.flatnonzero(~np.isfinite(out))
    if len(bad):
        out[bad] = np.einsum("ij,ij->i", units(a[bad]), units(b[bad]))
    return out


class Found:
    """What a task finds out about the classes of two groups: the sum of what each is linked to, and a forest of the links."""

    def __init__(self, rep: list, n: np.ndarray, mirrored: bool):
        self.rep, self.n, self.mirrored = rep, n, mirrored
        self.order = np.array(sorted(range(len(rep)), key=rep.__getitem__), np.int64)
        self.place = np.empty(len(rep), np.int64)
        self.place[self.order] = np.arange(len(rep))
        self.low, self.links = np.arange(len(rep)), np.zeros(len(rep), np.int64)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = i[i != j], j[i != j]
        np.add.at(self.links, i, self.n[j])
        if not self.mirrored:
            np.add.at(self.links, j, self.n[i])
        self.low = local_forest(len(self.low), self.place[i], self.place[j], self.low)

    def rows(self, kind: pa.DataType, open_: np.ndarray) -> dict[str, pa.Array]:
        """(rep, links, to, open) of the classes that are linked or open."""
        root = self.order[self.low[self.place]]
        seen = np.flatnonzero((self.links > 0) | (root != np.arange(len(root))) | open_)
        return {"rep": pa.array([self.rep[k] for k in seen], kind), "links": pa.array(self.links[seen]), "to": pa.array([self.rep[root[k]] for k in seen], kind), "open": pa.array(open_[seen])}


def near_embeddings(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """(id, n_links long, component_id, kept boolean): vectors of equal, non-null labels link at cosine >= threshold.

    n_links counts the other vectors linked directly, component_id is the smallest id that links reach, kept says it is
    the vector's own. Null, empty and zero vectors, those with null or non-finite components and those of another length than
    another do not link with that one. Rows with an id and vector that another row has as well count once, and each gets
    a row; rows with one id and different vectors are vectors of their own, which may link. Rows without an id don't link.

    Equal vectors of a label are one class, compared once, so copies cost nothing and still count as links. A label's
    classes are dealt over as many groups as its size asks for, and each pair of groups is one task: a label with a
    third of the rows is many tasks. Tasks get vectors as int8 numbers, made once, with their scale and what they miss. What
    the bounds leave open is computed in double precision by a second task of that pair of groups, which gets the vectors
    of open pairs only. A task gives sums and a forest of the links, never the pairs.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    own = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"), F.col(f"`{vector_col}`").cast("array<double>").alias("_v"))
    finite = ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    own = own.withColumn("_v", F.transform("_v", lambda x: x + F.lit(0.0)))
    valid = F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_v").isNotNull() & F.coalesce(finite, F.lit(False))
    own = own.withColumn("_class", F.when(valid, F.concat(F.hex(F.xxhash64("_label", "_v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "_v", "_label")))))
    own = staged(own.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    named = own.where(F.col("_class").isNotNull()).select("_class", "_id", "_row", "_label", F.size("_v").alias("_size"))
    named = named.groupBy("_class", "_id").agg(F.min("_row").alias("_row"), F.first("_label").alias("_label"), F.first("_size").alias("_size"))
    first = F.min(F.struct("_id", "_row")).alias("first")
    parts = named.groupBy("_class", salt("_id").alias("_salt")).agg(first, F.count("*").alias("n"), F.first("_label").alias("_label"), F.first("_size").alias("_size"))
    classes = parts.groupBy("_class").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.first("_label").alias("_label"), F.first("_size").alias("_size"))
    classes = staged(classes.select("_class", F.col("first._id").alias("rep"), F.col("first._row").alias("_row"), "n", "_label", "_size"), "classes")
    sizes = classes.groupBy("_label", "_size", salt("_class").alias("_salt")).count().groupBy("_label", "_size").agg(F.ceil(F.sum("count") / tile).cast("int").alias("groups"))
    spread = classes.withColumn("_salt", salt("_class")).join(sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_label", "_size", "_salt"])
    spread = spread.withColumn("g", F.pmod(F.xxhash64(F.lit("group"), "_class"), "groups").cast("int"))

    def quantise(batches):
        for batch in batches:
            size = batch["_size"].to_numpy()
            q, more = [None] * len(size), np.zeros((3, len(size)))
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                x = batch["_v"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                codes, *rest = quantised(units(x))
                more[:, at] = rest
                for k, c in zip(at.tolist(), codes, strict=True):
                    q[k] = c.tobytes()
            yield pa.record_batch([*(batch[c] for c in ("_label", "_size", "_class", "n", "g", "groups")), pa.array(q, pa.binary()), *map(pa.array, more)], names=["_label", "_size", "_class", "n", "g", "groups", "q", "scale", "held", "missed"])

    label = vectors.schema[label_col].dataType.simpleString()
    spread = own.select("_row", "_v").join(small(staged(spread.select("_row", "_label", "_size", "_class", "n", "g", "groups"), "groups")), "_row")
    codes = staged(spread.select("_label", "_size", "_class", "n", "g", "groups", "_v").mapInArrow(quantise, f"_label {label}, _size int, _class string, n long, g int, groups int, q binary, scale double, held double, missed double"), "codes")
    PAIR = ["_label", "_size", "x", "y"]
    pairs = codes.select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other")).withColumn("x", F.least("g", "other")).withColumn("y", F.greatest("g", "other")).drop("other", "groups")

    def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        g = table["g"].to_numpy()
        return np.flatnonzero(g == table["x"][0].as_py()), np.flatnonzero(g == table["y"][0].as_py())

    def compare(table: pa.Table) -> pa.Table:
        size, (first, second) = table["_size"][0].as_py(), sides(table)
        q = np.frombuffer(b"".join(table["q"].to_pylist()), np.int8).reshape(len(table), size)
        more = [table[c].to_numpy() for c in ("scale", "held", "missed")]
        found, open_ = Found(table["_class"].to_pylist(), table["n"].to_numpy(), len(first) == len(table)), np.zeros(len(table), bool)
        for i, j, sure in judged_pairs((q[first], *(m[first] for m in more)), (q[second], *(m[second] for m in more)), threshold):
            i, j = first[i], second[j]
            found.link(i[sure], j[sure])
            left = ~sure & (i != j)
            open_[i[left]] = open_[j[left]] = True
        out = found.rows(pa.string(), open_)
        return pa.table({c: table[c].take(pa.array(np.zeros(len(out["rep"]), np.int64))) for c in PAIR} | out)

    def recompute(table: pa.Table) -> pa.Table:
        size, (first, second) = table["_size"][0].as_py(), sides(table)
        v = table["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), size)
        u = units(v)
        all_codes = quantised(u)
        found = Found(table["_class"].to_pylist(), table["n"].to_numpy(), table["x"][0].as_py() == table["y"][0].as_py())
        for i, j, sure in judged_pairs([c[first] for c in all_codes], [c[second] for c in all_codes], threshold):
            i, j = first[i[~sure]], second[j[~sure]]
            for m in range(0, len(i), 1 << 16):
                p, o = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
                near = cosines(v[p], v[o]) >= threshold
                found.link(p[near], o[near])
        out = found.rows(pa.string(), np.zeros(len(table), bool))
        return pa.table({c: out[c] for c in ("rep", "links", "to")})

    schema = f"_label {label}, _size int, x int, y int, rep string, links long, to string, open boolean"
    sure = staged(pairs.repartition(n_parts(spark), *PAIR).groupBy(*PAIR).applyInArrow(compare, schema), "sure-links")
    wanted = sure.where("open").select(*PAIR, F.col("rep").alias("_class"))
    whole = wanted.join(classes.select("_class", "_row", "n"), "_class").join(codes.select("_class", "g"), "_class")
    whole = own.select("_row", "_v").join(small(staged(whole, "open")), "_row")
    exact = whole.select(*PAIR, "g", "_class", "n", "_v").repartition(n_parts(spark), *PAIR).groupBy(*PAIR).applyInArrow(recompute, "rep string, links long, to string")
    found = staged(sure.select("rep", "links", "to").union(exact), "links")
    roots = components(found.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    table = classes.select("_class", "rep", "n").join(links.withColumnRenamed("rep", "_class"), "_class", "left").join(roots.withColumnRenamed("node", "_class"), "_class", "left")
    table = staged(table.select("_class", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("root", "_class").alias("_root")), "linked")
    least = table.groupBy("_root", salt("_class").alias("_salt")).agg(F.min("rep").alias("low")).groupBy("_root").agg(F.min("low").alias("component_id"))
    table = look_up(table, "_root", least, "_class").select("_class", "n_links", "component_id")
    out = look_up(own.select("_id", "_class"), "_class", table, "_id")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast(kind).alias("component_id"), (F.col("_id") == component).alias("kept"))


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
      WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
