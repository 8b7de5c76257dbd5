"""Substring dedup: passages of at least min_words words that a document with a smaller id has too are cut."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import Blocks, mix, pack, places_of, staged, unframed, unpack

#: Odd bases of the two window hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Windows of a stretch that is looked up as a whole, on average.
STRETCH = 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def rolling(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """At i: the sum of h[i + j] * base**j for j < length, modulo 2**64. Built from windows of doubling length."""
    out, size, part, step = None, 0, h, 1
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    while length:
        if length & 1:
            out = part.copy() if out is None else out + shifted(part, size) * power(size)
            size += step
        length >>= 1
        if length:
            part = part + shifted(part, step) * power(step)
            step *= 2
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """At i: the least of x[i : i + width]; positions near the end are not to be used."""
    out, size = x, 1
    while size < width:
        by = min(size, width - size)
        out = np.minimum(out, np.concatenate([out[by:], out[len(out) - by :]]) if by < len(out) else out)
        size += by
    return out


def extremes(values: np.ndarray, docs: np.ndarray):
    """(distinct values sorted, each one's place among them, the least and the greatest id of each)."""
    keys, which = np.unique(values, return_inverse=True)
    low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, which, docs)
    np.maximum.at(high, which, docs)
    return keys, which, low, high


def levels_of(min_words: int, shortest: int) -> list[int]:
    """Window lengths that double up to min_words, from the last one that is not under shortest; two at least."""
    out = [min_words]
    while len(out) < 2 or (out[0] + 1) // 2 >= shortest and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def digest(table: pa.Table) -> bytes:
    """What looks at a block need of its texts: words as numbers, and the hashes of the distinct words."""
    import xxhash

    class Numbers(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    numbers, arrays, ids = Numbers(), [], table["i"]
    for text in table["t"].to_pylist():
        words = (text or b"").split()
        arrays.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return pack(ids.fill_null(0).to_numpy(), known, np.array([len(a) for a in arrays], np.int64), np.concatenate([*arrays, np.zeros(0, np.uint32)]), hashes)


class Windows:
    """Words, and windows of min_words words, of the rows of a block that have an id."""

    def __init__(self, held: bytes, min_words: int):
        ids, known, self.sizes, numbers, hashes = unpack(held)
        self.h, self.min_words = hashes[numbers], min_words
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        self.at = np.flatnonzero((np.arange(len(self.h)) + min_words <= ends) & np.repeat(known, self.sizes))
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.at]
        self.doc = ids[self.row]

    def least_parts(self, length: int) -> np.ndarray:
        """For each window the least hash of the windows of this length in it. Equal windows have equal least parts, so a window
        whose least part no other document has cannot repeat; and windows side by side mostly share theirs, so only one
        part in about half as many as a window has needs to be looked up."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        return sliding_min(mix(rolling(self.h, length, BASES[0])), self.min_words - length + 1)[self.at]

    def survivors(self, replies: pa.Table | None, lengths: list[int]) -> np.ndarray:
        """The windows whose least parts of these lengths other documents have too."""
        chosen = np.arange(len(self.at))
        for k, length in enumerate(lengths):
            found = replies.filter(pa.compute.equal(replies["level"], k))["key"].to_numpy().view(np.uint64)
            chosen = chosen[np.isin(self.least_parts(length)[chosen], found)] if len(found) else chosen[:0]
        return chosen

    def segments(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, more, segment of each chosen window): stretches of chosen windows that begin where a run of them or, as the
        words there decide, about every STRETCH windows, and 96 bits of the hash of all the words of a stretch's windows."""
        if not len(chosen):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        at, row = self.at[chosen], self.row[chosen]
        new = mix(rolling(self.h, min(4, self.min_words), BASES[1]) ^ np.uint64(1))[at] % np.uint64(STRETCH) == 0
        new[0] = True
        new[1:] |= (np.diff(at) != 1) | (np.diff(row) != 0)
        starts = np.flatnonzero(new)
        first, end = at[starts], at[np.append(starts[1:], len(at)) - 1] + self.min_words
        keys = []
        for h, base in ((self.h, BASES[0]), (mix(self.h), BASES[1])):
            power, back = np.full(len(h), base, np.uint64), np.full(len(h), pow(base, -1, 1 << 64), np.uint64)
            power[0] = back[0] = 1
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(power))])
            keys.append(mix((sums[end] - sums[first]) * np.cumprod(back)[first] ^ mix((end - first).astype(np.uint64))))
        return keys[0], keys[1].astype(np.uint32), np.cumsum(new) - 1

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, more, the window itself): 96 bits of the hash of each chosen window's words."""
        at = self.at[chosen]
        key = mix(rolling(self.h, self.min_words, BASES[1]))[at] if len(at) else np.zeros(0, np.uint64)
        more = mix(rolling(mix(self.h), self.min_words, BASES[0]))[at] if len(at) else np.zeros(0, np.uint64)
        return key, more.astype(np.uint32), np.arange(len(chosen))

    def later(self, chosen: np.ndarray, found, replies: pa.Table, level: int) -> np.ndarray:
        """Which chosen windows, or all in a segment of them, a document with a smaller id has: by what the block itself has, and
        what the replies of a level say."""
        key, more, which = found
        first, place, low = earliest(key, more, which, self.doc[chosen])
        ahead = replies.filter(pa.compute.equal(replies["level"], level))
        at = places_of(key[first], more[first], ahead["key"].to_numpy().view(np.uint64), ahead["more"].to_numpy().view(np.uint32))
        low[at >= 0] = ahead["low"].to_numpy()[at[at >= 0]]
        return low[place[which]] < self.doc[chosen]


def earliest(key: np.ndarray, more: np.ndarray, which: np.ndarray, doc: np.ndarray):
    """(first, place, low): of each distinct (key, more) one entry, each entry's place among these, and the least id of the
    windows (`which` entry each belongs to, and id) of each."""
    order = np.lexsort((more, key))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(more[order]) != 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    low = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(low, place[which], doc)
    return order[new], place, low


ASKED = "_block int, level int, key long, more int, low long, high long"


def requests(block: int, level: int, keys: np.ndarray, more: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Table:
    n = len(keys)
    return pa.table({"_block": np.full(n, block, np.int32), "level": np.full(n, level, np.int32), "key": keys.view(np.int64), "more": more.view(np.int32), "low": low, "high": high})


def dedup_substrings(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_space: bool = True, shortest: int = 7, prefix: str = "") -> DataFrame:
    """The documents' rows and columns, the text without repeated passages, and n_words and n_removed (long).

    A word goes if a window of min_words consecutive words covers it whose words also stand in a row with a smaller id.
    Windows are judged on the input. Lengths double from level to level, from `shortest` or a little more: what another
    document has at one length alone is looked up at the next, by the least hash among a window's parts of that
    length. Levels end as soon as nothing survives. Of the full length, stretches of surviving windows are looked up
    first, all their words at once: one that a document with a smaller id has goes as a whole, so of copies, and near
    copies, only the first is looked up window by window. Longer windows would remove no word more, as they are windows of
    the full length side by side. A block asks once for a key however often it has it, and is told of keys that other
    documents have too; a key in very many documents is one row a block.

    Words are split at ASCII white space. White space between kept words stays as it is, or becomes one space each
    without keep_space. Null texts stay null and have no words; rows without an id stay whole and are no witnesses; rows with
    equal ids don't witness against each other. Ids may be of any type that has an order. Columns of the documents named
    n_words or n_removed are replaced; these names begin with prefix.
    """
    blocks, lengths = Blocks(docs, id_col, text_col, digest), levels_of(min_words, shortest)[:-1]
    whole, single = len(lengths), len(lengths) + 1

    def look(level: int):
        def ask(block: int, row: dict, replies: pa.Table | None = None) -> pa.Table:
            windows = Windows(row["digest"], min_words)
            chosen = windows.survivors(replies, lengths[:level])
            if level < whole:
                keys, _, low, high = extremes(windows.least_parts(lengths[level])[chosen], windows.doc[chosen])
                return requests(block, level, keys, np.zeros(len(keys), np.uint32), low, high)
            found = windows.segments(chosen)
            if level == single:
                chosen = chosen[~windows.later(chosen, found, replies, whole)]
                found = windows.windows(chosen)
            first, _, low = earliest(*found, windows.doc[chosen])
            return requests(block, level, found[0][first], found[1][first], low, low)

        return ask

    def cut(block: int, row: dict, replies: pa.Table) -> pa.Table:
        table, windows = unframed(row["rows"]), Windows(row["digest"], min_words)
        gone = np.zeros(len(windows.h), bool)
        if len(replies):
            chosen = windows.survivors(replies, lengths)
            later = windows.later(chosen, windows.segments(chosen), replies, whole)
            left = chosen[~later]
            gone_at = windows.at[np.concatenate([chosen[later], left[windows.later(left, windows.windows(left), replies, single)]])]
            steps = np.zeros(len(windows.h) + 1, np.int64)
            np.add.at(steps, gone_at, 1)
            np.add.at(steps, gone_at + min_words, -1)
            gone = np.cumsum(steps)[:-1] > 0
        ends, texts, removed = np.cumsum(windows.sizes).tolist(), table["t"].to_pylist(), []
        for k, (text, size) in enumerate(zip(texts, windows.sizes.tolist(), strict=True)):
            own = gone[ends[k] - size : ends[k]]
            removed.append(int(own.sum()))
            if text is not None and not keep_space:
                words = text.split()
                texts[k] = b" ".join(w for w, no in zip(words, own.tolist(), strict=True) if not no) if removed[-1] else b" ".join(words)
            elif removed[-1]:
                texts[k] = without(text, own)
        return blocks.out(table, texts, _words=pa.array(windows.sizes, pa.int64()), _removed=pa.array(removed, pa.int64()))

    found = docs.sparkSession.createDataFrame([], "_block int, level int, key long, more int, low long")
    for level in range(single + 1):
        asked = blocks.ask(look(level), ASKED, None if level == 0 else found, ("digest",)).repartition(blocks.tasks, "key", "more")
        key = Window.partitionBy("key", "more")
        met = asked.select("_block", "level", "key", "more", "low", F.min("low").over(key).alias("_least"), F.max("high").over(key).alias("_most"))
        told = met.where(F.col("_least") < (F.col("_most") if level < whole else F.col("low")))
        told = staged(told.select("_block", "level", "key", "more", F.col("_least").alias("low")), f"level-{[*lengths, 'stretches', min_words][level]}")
        found = found.union(told)
        if level < whole and told.isEmpty():
            break
    out = blocks.ask(cut, blocks.schema("_words long, _removed long"), found, ("rows", "digest"))
    return blocks.restore(out, {"_words": prefix + "n_words", "_removed": prefix + "n_removed"})


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone and the white space after each."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
    out, at = [], 0
    for a, b in zip(turns[::2], turns[1::2], strict=True):
        out.append(text[at : starts[a]])
        at = starts[b]
    return b"".join([*out, text[at:]])


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs, keep_space=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS p FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first_id FROM s GROUP BY h),
g AS (SELECT DISTINCT s.doc_id, p + unnest(generate_series(0, 49)) AS q FROM s JOIN f USING (h) WHERE first_id < s.doc_id),
r AS (SELECT doc_id, list(q) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(list_zip(ws, generate_series(1, len(ws))), lambda x: gone IS NULL OR NOT list_contains(gone, x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
