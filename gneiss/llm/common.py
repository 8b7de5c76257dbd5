"""What the text operators share: shared storage, packed arrays, blocks, and connected components."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.common import SALTS, bucketed, look_up, new_path, numbered, release, salt, shared_dir, staged

__all__ = ["SALTS", "bucketed", "look_up", "new_path", "numbered", "release", "salt", "shared_dir", "staged"]

#: Bytes of text of a block, and of a task's blocks; the number of tasks that Spark allows a bucketed table by default.
BLOCK_BYTES, TASK_BYTES, MOST_TASKS = 2 << 20, 16 << 20, 100_000
#: Most rows of a narrow table that are sent to all executors; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A staged, narrow table as a broadcast if it has few rows, which are counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def trimmed(table):
    """Gives memory that the process has freed back to the system: idle workers hold theirs beside those at work."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library
    return table


_cache: dict = {}


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process."""
    return _cache


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame, bytes of equal weight side by side."""
    import zstandard

    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [struct.pack("<cQ", a.dtype.char.encode(), len(a)), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 1
    for _ in range(raw[0]):
        char, n = struct.unpack_from("<cQ", raw, at)
        kind = np.dtype(char.decode())
        at += 9
        body = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(body.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_block(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """The columns after `_block`, a hash of the id: the unit that later stages meet in. Null ids have blocks by their text."""
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    return docs.select(F.pmod(key, F.lit(blocks)).cast("int").alias("_block"), "*")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that can be reached.

    Each round maps a node to its least neighbour, follows these pointers to their end and contracts the edges, so what
    is left shrinks at least by half in all but contrived graphs, and no node's neighbours are ever gathered in one
    place: there are only minima, equi-joins with a unique side, and distinct. Rounds are written to the shared folder.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    found = None
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = staged(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "up")
        while True:
            moved = up.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("further"))
            on = up.join(moved, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
            on = staged(on, "up")
            if on.where("moved").isEmpty():
                break
            up = on.select("node", "root")
        roots = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = up if found is None else staged(found.join(roots, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "found")
        a, b = (up.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        edges = edges.join(a, "a").join(b, "b").where("root_a <> root_b")
        edges = staged(edges.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
    return spark.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}") if found is None else found


def local_forest(n: int, i: np.ndarray, j: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (i, j), from labels `low` on."""
    low = np.arange(n) if low is None else low
    while True:
        a, b = low[i], low[j]
        apart = a != b
        if not apart.any():
            return low
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        least, new = np.minimum(a, b), low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        while (further := new[new]).tobytes() != new.tobytes():
            new = further
        low = new[low]


def column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def chunks(batches):
    """The rows of a batch that go to the same block, compressed together: a third less to shuffle, and fewer rows."""
    for batch in batches:
        block = batch["_block"].to_numpy(zero_copy_only=False)
        order = np.argsort(block, kind="stable")
        rows = pa.RecordBatch.from_arrays([batch.column(k) for k in range(1, batch.num_columns)], names=batch.schema.names[1:]).take(pa.array(order))
        at = np.flatnonzero(np.diff(block[order], prepend=-1))
        out = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(block)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_batch(rows.slice(a, b - a))
            out.append(sink.getvalue().to_pybytes())
        yield pa.record_batch({"_block": pa.array(block[order][at], pa.int32()), "chunk": pa.array(out, pa.binary())})


def framed(table: pa.Table) -> bytes:
    """The table as one compressed stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(table)
    return sink.getvalue().to_pybytes()


def unframed(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def with_ordinal(docs: DataFrame, id_col: str, to: str) -> DataFrame:
    """docs with `to` (long), which orders rows as the id does, equal ids equal and null ids null: whole numbers themselves, and
    the places of the distinct values of any other type."""
    own, kind = F.col(f"`{id_col}`"), docs.schema[id_col].dataType
    if isinstance(kind, T.IntegralType):
        return docs.select(own.cast("long").alias(to), "*")
    places = numbered(docs.select(own.alias("_key")).where("_key IS NOT NULL").distinct(), [F.asc("_key")], to)
    rows = docs.select(own.alias("_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.monotonically_increasing_id().alias("_spread"))
    return look_up(rows, "_key", places, "_spread").select(to, *(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


class Blocks:
    """Documents in blocks by a hash of their id, for operators that need several looks at a text.

    A block holds BLOCK_BYTES of text on average, whatever the corpus and spark.sql.shuffle.partitions, and is what a
    function gets at a time: one row with `rows` (all columns of its documents) and `digest` (what a function of the caller
    makes of them, for looks that don't need the texts). Blocks are a table in shared storage, bucketed by their
    number, so texts are shuffled once, no look shuffles them again, and a lost executor costs its task. Tasks hold
    TASK_BYTES on average up to MOST_TASKS of them.

    In the rows, `i` is the id's ordinal, `t` the text in UTF-8, and the other columns have names of their own, so
    no column of the documents can clash. A block's content, and all that is derived from it, depends on the documents
    alone. What blocks must learn of each other are plain rows, one for a key and block, reduced by min and max over a key.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, digest=None):
        spark = docs.sparkSession
        self.names, self.types, self.id_col, self.text_col = docs.columns, docs.schema, id_col, text_col
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("binary")))).first()[0] or 0
        self.blocks = max(n_parts(spark), -(-size // BLOCK_BYTES))
        self.tasks = max(n_parts(spark), min(MOST_TASKS, -(-size // TASK_BYTES)))
        whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
        self.inner = {n: "i" if n == id_col and whole else "t" if n == text_col else f"c{k}" for k, n in enumerate(docs.columns)}
        own = with_ordinal(docs, id_col, "_ordinal")
        own = own.select(F.col("_ordinal").alias("i"), *(F.col(f"`{n}`").cast("binary" if n == text_col else self.types[n].dataType).alias(x) for n, x in self.inner.items() if x != "i"))
        self.inner_types = [(x, "long" if x == "i" else "binary" if n == text_col else self.types[n].dataType.simpleString()) for n, x in self.inner.items()]

        def merge(key, chunks_of_block):
            table = pa.concat_tables(unframed(x) for x in chunks_of_block["chunk"].to_pylist())
            return trimmed(pa.table({"_block": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([framed(table)], pa.binary()), "digest": pa.array([digest(table) if digest else None], pa.binary())}))

        dealt = with_block(own, "i", "t", self.blocks).mapInArrow(chunks, "_block int, chunk binary").repartition(self.tasks, "_block")
        merged = dealt.groupBy("_block").applyInArrow(merge, "_block int, rows binary, digest binary")
        self.table = bucketed(merged, "blocks", self.tasks, "_block")

    def ask(self, f, schema: str, replies: DataFrame | None = None, columns: tuple[str, ...] = ("rows",)) -> DataFrame:
        """f(number, row[, replies]) of each block: row has the columns of the block's row; replies have `_block`."""
        groups = self.table.select("_block", *columns).groupBy("_block")

        def row(t: pa.Table) -> dict:
            return t.slice(0, 1).to_pylist()[0]

        if replies is None:
            return groups.applyInArrow(lambda key, t: trimmed(f(key[0].as_py(), row(t))), schema)
        return groups.cogroup(replies.groupBy("_block")).applyInArrow(lambda key, t, r: trimmed(f(key[0].as_py(), row(t), r)), schema)

    def block_of(self, ordinals) -> list[int]:
        """The blocks of documents, by their ordinals: what with_block says."""
        import xxhash

        hashes = (xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) for i in ordinals)
        return [(h - (1 << 64) if h >> 63 else h) % self.blocks for h in hashes]

    def __getstate__(self) -> dict:
        """What functions on executors need of it."""
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "types")}

    def out(self, table: pa.Table, texts: list[bytes | None], **more: pa.Array) -> pa.Table:
        """The rows with other texts, and columns after them."""
        made = {x: pa.array(texts, pa.binary()) if x == "t" else table[x] for x, _ in self.inner_types}
        return pa.table({**made, **more})

    def restore(self, out: DataFrame, more: dict[str, str]) -> DataFrame:
        """The documents' columns under their own names and order, then more: name in `out` -> name of the column, in place of
        a column of that name that the documents have."""
        own = [F.col(x).cast(self.types[n].dataType).alias(n) for n, x in self.inner.items() if n not in more.values()]
        return out.select(*own, *(F.col(x).alias(n) for x, n in more.items()))

    def schema(self, more: str) -> str:
        return ", ".join(f"{x} {t}" for x, t in self.inner_types) + (f", {more}" if more else "")


def places_of(keys: np.ndarray, more: np.ndarray, found_keys: np.ndarray, found_more: np.ndarray) -> np.ndarray:
    """For each (key, more) its place among the found ones, which differ, or -1."""
    order = np.lexsort((found_more, found_keys))
    k, m = found_keys[order], found_more[order]
    out, at = np.full(len(keys), -1, np.int64), np.searchsorted(k, keys)
    left = np.flatnonzero(at < len(k))
    while len(left):
        left = left[k[at[left]] == keys[left]]
        hit = m[at[left]] == more[left]
        out[left[hit]] = order[at[left[hit]]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < len(k)]
    return out
