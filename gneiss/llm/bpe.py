"""Byte-level BPE: encoding by one global shuffle of distinct words, decoding by the token-byte table."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import MOST_TASKS, TASK_BYTES, chunks, n_parts, pack, trimmed, unframed, unpack, with_block, worker_cache

#: Bytes of text of a block, and the blocks whose words are as many as a bucket's.
BLOCK_BYTES, NEIGHBOURS = 3 << 20, 9


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file, read once in a process."""
    cache = worker_cache()
    if ("ranks", path) not in cache:
        with open(path, "rb") as f:
            cache["ranks", path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    return cache["ranks", path]


def piece_encoder(path: str, pattern: str):
    """A function from one pre-token to its ids: the rank encoder without any splitting of its own."""
    import tiktoken

    cache = worker_cache()
    if ("encoding", path) not in cache:
        cache["encoding", path] = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks_of(path), special_tokens={})
    return cache["encoding", path].encode_ordinary


def by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted unsigned 64-bit keys, which fall into buckets by their size."""
    if not len(keys):
        return []
    width = (1 << 64) // buckets + 1
    edges = np.searchsorted(keys, np.array([i * width for i in range(1, buckets)], np.uint64))
    edges = [0, *edges.tolist(), len(keys)]
    return [(i, edges[i], edges[i + 1]) for i in range(buckets) if edges[i] < edges[i + 1]]


def in_order(words: list[str], buckets: int) -> tuple[list[str], np.ndarray, list[tuple[int, int, int]]]:
    """Different words by their hash; their places before; (bucket, from, to). The order depends on the words alone."""
    import xxhash

    keys = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    order = np.argsort(keys, kind="stable")
    if (np.diff(keys[order]) == 0).any():
        order = np.array(sorted(order.tolist(), key=lambda k: (keys[k], words[k])), np.int64)
    return [words[k] for k in order.tolist()], order, by_bucket(keys[order], buckets)


class Words(dict):
    """Numbers the distinct pre-tokens of texts as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Exchange:
    """Texts in blocks by a hash of their id, and the messages between blocks and buckets of words.

    Blocks hold BLOCK_BYTES of text on average and buckets the words of NEIGHBOURS blocks, whatever the corpus and
    spark.sql.shuffle.partitions. Both looks at the texts are groupings of one plan, so Spark shuffles the texts once. A block's
    words for a bucket are one message, and so is a bucket's reply; where a corpus has more buckets than a block has words, that
    is a row for each word of a block.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("binary")))).first()[0] or 0
        self.blocks = max(n_parts(spark), -(-size // BLOCK_BYTES))
        self.buckets = -(-self.blocks // NEIGHBOURS)
        self.tasks = max(n_parts(spark), min(MOST_TASKS, -(-size // TASK_BYTES)))
        own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("binary").alias("t"))
        self.rows = with_block(own, "i", "t", self.blocks).mapInArrow(chunks, "_block int, chunk binary").repartition(self.tasks, "_block")

    def __getstate__(self) -> dict:
        """What functions on executors need of it."""
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def ask(self, f, schema: str, replies: DataFrame | None = None) -> DataFrame:
        """f(number, rows[, replies]) of each block, where replies has `_block`."""

        def whole(table: pa.Table) -> pa.Table:
            return pa.concat_tables(unframed(x) for x in table["chunk"].to_pylist())

        groups = self.rows.groupBy("_block")
        if replies is None:
            return groups.applyInArrow(lambda key, t: trimmed(f(key[0].as_py(), whole(t))), schema)
        return groups.cogroup(replies.groupBy("_block")).applyInArrow(lambda key, t, r: trimmed(f(key[0].as_py(), whole(t), r)), schema)

    def answer(self, asked: DataFrame, f) -> DataFrame:
        """asked: (bucket, block, payload). f(arrays of each block that asks) gives each block's reply: (_block, bucket, payload)."""

        def by_whole_bucket(batches):
            held = {}
            for batch in batches:
                for bucket, block, payload in zip(*(batch[n].to_pylist() for n in ("bucket", "block", "payload")), strict=True):
                    held.setdefault(bucket, []).append((block, payload))
            for bucket in list(held):
                own = held.pop(bucket)
                replies = [pack(*reply) for reply in f([unpack(p) for _, p in own])]
                yield trimmed(pa.record_batch({"_block": pa.array([b for b, _ in own], pa.int32()), "bucket": pa.array([bucket] * len(own), pa.int32()), "payload": pa.array(replies, pa.binary())}))

        # Dealt by block here, so that replies are made once.
        return asked.repartitionById(max(1, min(self.buckets, self.tasks)), F.col("bucket") % max(1, min(self.buckets, self.tasks))).mapInArrow(by_whole_bucket, "_block int, bucket int, payload binary").repartition(self.tasks, "_block")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): every whole text's token ids as little-endian unsigned 32-bit integers; `ids_array` makes an array.

    Texts meet in blocks. A block sends each distinct pre-token once to the bucket of the word's hash; the bucket encodes
    a distinct word once and sends the ids to the blocks that have the word; a block then puts the ids at all positions
    of the word. So what is shuffled besides the texts are distinct words of blocks, and a word as common as " the" is one
    entry for each block.

    Null and empty texts have no ids. Rows with equal ids or equal texts each give a row, and ids may be of any type. Other
    columns are not read.
    """
    texts, kind = Exchange(docs, id_col, text_col), docs.schema[id_col].dataType.simpleString()

    def words_of(block: int, table: pa.Table) -> pa.Table:
        import regex

        cut, words = regex.compile(pattern).findall, set()
        for text in table["t"]:
            words.update(cut((text.as_py() or b"").decode("utf-8", "replace")))
        ordered, _, buckets = in_order(list(words), texts.buckets)
        out = []
        for _, a, b in buckets:
            raw = [w.encode() for w in ordered[a:b]]
            out.append(pack(np.array([len(x) for x in raw], np.uint32), np.frombuffer(b"".join(raw), np.uint8)))
        return pa.table({"bucket": pa.array([x for x, _, _ in buckets], pa.int32()), "block": pa.array([block] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})

    def encode_words(asked: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        encode_piece, known, out = piece_encoder(ranks_path, pattern), {}, []
        for sizes, blob in asked:
            blob, ends, ids, counts = blob.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist(), [], []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                word = blob[a:b]
                if (own := known.get(word)) is None:
                    own = known[word] = encode_piece(word.decode())
                ids += own
                counts.append(len(own))
            out.append((np.array(counts, np.uint32), np.array(ids, np.uint32)))
        return out

    def assemble(block: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        import regex

        cut, words, places = regex.compile(pattern).findall, Words(), []
        for text in table["t"]:
            own = cut((text.as_py() or b"").decode("utf-8", "replace"))
            places.append(np.fromiter(map(words.__getitem__, own), np.uint32, len(own)))
        _, order, _ = in_order(list(words), texts.buckets)
        order, ids_of, at = order.tolist(), [b""] * len(words), 0
        for _, payload in sorted(zip(replies["bucket"].to_pylist(), replies["payload"].to_pylist(), strict=True)):
            counts, ids = unpack(payload)
            raw, ends = ids.tobytes(), (np.cumsum(counts, dtype=np.int64) * 4).tolist()
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                ids_of[order[at]] = raw[a:b]
                at += 1
        if at != len(words):
            raise RuntimeError(f"block {block} got ids for {at} of {len(words)} words")
        return pa.table({"i": table["i"], "ids": pa.array((b"".join(map(ids_of.__getitem__, x.tolist())) for x in places), pa.binary())})

    replies = texts.answer(texts.ask(words_of, "bucket int, block int, payload binary"), encode_words)
    return texts.ask(assemble, f"i {kind}, ids binary", replies).withColumnRenamed("i", id_col)


def ids_array(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds `to`, the bytes of the ids. The token-byte table has a row for each id of the vocabulary and no more, so
    each task joins its own copy of it. No ids, or null: no bytes. An id that is not in the vocabulary is an error."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.BinaryType())])
    names = encoded.columns

    def join_table(batches):
        ranks = ranks_of(ranks_path)
        known = sorted((i, token) for token, i in ranks.items())
        size, start = np.zeros(known[-1][0] + 1, np.int64), np.zeros(known[-1][0] + 1, np.int64)
        at = np.array([i for i, _ in known])
        size[at] = [len(token) for _, token in known]
        start[at] = np.cumsum(size[at]) - size[at]
        letters, missing = np.frombuffer(b"".join(token for _, token in known), np.uint8), size == 0

        def text_of(raw: bytes) -> bytes:
            ids, out = np.frombuffer(raw, "<u4"), []
            if len(ids) and (int(ids.max()) >= len(size) or missing[ids].any()):
                raise ValueError("an id is not in the vocabulary")
            for k in range(0, len(ids), 1 << 18):
                own = ids[k : k + (1 << 18)]
                n = size[own]
                ends = np.cumsum(n)
                out.append(letters[np.arange(ends[-1]) + np.repeat(start[own] - ends + n, n)].tobytes())
            return b"".join(out)

        for batch in batches:
            out = [text_of(x or b"") for x in batch[ids_col].to_pylist()]
            yield pa.record_batch([*(batch[n] for n in names), pa.array(out, pa.binary())], names=[*names, to])

    return encoded.mapInArrow(join_table, schema)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
