"""Line dedup by deletion neighbourhoods: lines within a number of edits of an earlier line go, across all documents."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import Blocks, mix, places_of, staged, unframed

#: Odd bases and character seeds of the two line hashes.
BASES = ((0x9E3779B97F4A7C15, 0x51AFD7ED558CCD01), (0xD6E8FEB86659FD93, 0xC4CEB9FE1A85EC53))
EXACT, HALF, VARIANT, LOCAL = 0, 1, 2, 3


def grouped(key: np.ndarray, more: np.ndarray, doc: np.ndarray, line: np.ndarray):
    """(first, which): entries sorted by (key, more), of each distinct one the earliest; and each entry's group."""
    order = np.lexsort((line, doc, more, key))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(more[order]) != 0)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def digests(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each string's hash: 64 and 32."""
    import xxhash

    own = [xxhash.xxh3_128_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings]
    return np.array([d & 0xFFFFFFFFFFFFFFFF for d in own], np.uint64), np.array([d >> 96 for d in own], np.uint32)


def variant_texts(line: str, bound: int) -> set[str]:
    """The variants of a line within the bound, as texts.

    A variant is what is left of the line after up to `bound` deletions, and `bound` gaps in it, of which the deletions
    are some. Two lines have one in common exactly if they are within the bound: what each lacks of the other is at the
    gaps, and a gap at which both lack a character is a substitution.
    """
    out = set()
    for n in range(bound + 1):
        for gone in combinations(range(len(line)), n):
            left = "".join(c for k, c in enumerate(line) if k not in gone)
            own = [k - j for j, k in enumerate(gone)]
            for others in combinations_with_replacement(range(len(left) + 1), bound - n):
                out.add(f"{sorted([*own, *others])}{left}")
    return out


class Lines:
    """The eligible lines of a block: those with at least min_exact characters, of rows that have an id. Those with
    min_chars, at least as many, are matched within edits too."""

    def __init__(self, rows: bytes, min_chars: int, min_exact: int):
        self.table = unframed(rows)
        self.ids, self.texts = self.table["i"].to_pylist(), [None if x is None else x.split(b"\n") for x in self.table["t"].to_pylist()]
        number, self.strings, which, docs, at = {}, [], [], [], []
        for who, text in zip(self.ids, self.texts, strict=True):
            if who is None or text is None:
                continue
            for k, raw in enumerate(text):
                if len(raw) < min_exact:
                    continue
                line = raw.strip().decode("utf-8", "replace")
                if len(line) < min_exact:
                    continue
                if (own := number.get(line)) is None:
                    own = number[line] = len(self.strings)
                    self.strings.append(line)
                which.append(own)
                docs.append(who)
                at.append(k)
        self.which, self.doc, self.at = np.array(which, np.int64), np.array(docs, np.int64), np.array(at, np.int64)
        order = np.lexsort((self.at, self.doc, self.which))
        first = order[np.flatnonzero(np.diff(self.which[order], prepend=-1))] if self.strings else np.zeros(0, np.int64)
        self.first_doc, self.first_at = self.doc[first], self.at[first]
        self.long = np.array([len(s) >= min_chars for s in self.strings], bool)
        self.key, self.more = digests(self.strings)

    def halves(self):
        """The hashes of the halves that two lines within one edit share, sorted; lines' least and greatest hash by
        half; and each long line's places: two prefixes, then two suffixes."""
        import xxhash

        out = []
        for s, long in zip(self.strings, self.long.tolist(), strict=True):
            if not long:
                continue
            n = len(s)
            for k in (n // 2, (n - 1) // 2):
                out.append(xxhash.xxh64_intdigest(s[:k].encode("utf-8", "surrogatepass"), 2 * k))
            for k in (n // 2, (n - 1) // 2):
                out.append(xxhash.xxh64_intdigest(s[n - k :].encode("utf-8", "surrogatepass"), 2 * k + 1))
        keys, place = np.unique(np.array(out, np.uint64), return_inverse=True)
        own = np.repeat(self.key[self.long].view(np.int64), 4)
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, place, own)
        np.maximum.at(high, place, own)
        return keys, low, high, place.reshape(-1, 4)

    def variants_within_one(self, chosen: np.ndarray, before: np.ndarray, after: np.ndarray):
        """(owner, key, more) of the chosen lines' variants within one edit, as variant_texts says what they are; of gaps in the
        first half where `before` is set, in the second where `after` is. Hashes come from sums over prefixes."""
        parts = []
        for k in range(0, len(chosen), 400):  # bounds the arrays below
            part = chosen[k : k + 400]
            texts = [self.strings[c] for c in part]
            size = np.array([len(t) for t in texts], np.int64)
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            start = np.concatenate([[0], np.cumsum(size)])
            # A line has a place for each character and one at its end: gaps; characters are what is deleted.
            line = np.repeat(np.arange(len(part)), size + 1)
            gap = np.arange(len(line)) - (start[:-1] + np.arange(len(part)))[line]
            half = (size[line] - 1) // 2
            look = (after[k : k + 400][line] & (gap >= half)) | (before[k : k + 400][line] & (gap <= size[line] - half))
            line, gap = line[look], gap[look]
            drops = gap < size[line]
            out = []
            for base, seed in BASES:
                inverse = pow(base, -1, 1 << 64)
                power, back = np.full(len(codes), base, np.uint64), np.full(len(codes), inverse, np.uint64)
                power[:1] = back[:1] = 1
                power, back = np.cumprod(power), np.cumprod(back)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes + np.uint64(seed)) * power)])
                o, to = start[:-1], np.concatenate([back, np.ones(1, np.uint64)])[start[:-1]]
                place = mix(gap.astype(np.uint64) + np.uint64(1 << 60))
                whole = ((sums[start[1:]] - sums[o]) * to ^ mix(size.astype(np.uint64)))[line]
                d, p = line[drops], gap[drops] + start[line[drops]]
                left, right = (sums[p] - sums[o[d]]) * to[d], (sums[start[d + 1]] - sums[p + 1]) * to[d] * np.uint64(inverse)
                less = (left + right) ^ mix((size[d] - 1).astype(np.uint64))
                out.append((mix(whole ^ place), mix(less ^ place[drops])))
            (w1, d1), (w2, d2) = out
            parts.append((np.concatenate([part[line], part[line[drops]]]), np.concatenate([w1, d1]), np.concatenate([w2, d2]).astype(np.uint32)))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        return tuple(np.concatenate([x[k] for x in (*parts, empty)]) for k in range(3))

    def variants(self, chosen: np.ndarray, bound: int):
        """The same for any bound, of whole lines."""
        owner, texts = [], []
        for c in chosen.tolist():
            own = variant_texts(self.strings[c], bound)
            owner += [c] * len(own)
            texts += own
        return np.array(owner, np.int64), *digests(texts)


def within(a: str, b: str, bound: int) -> bool:
    """Whether a and b are within `bound` insertions, deletions and substitutions."""
    if abs(len(a) - len(b)) > bound:
        return False
    ahead = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[ahead:], b[ahead:]
    behind = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - behind], b[: len(b) - behind]
    if max(len(a), len(b)) <= bound:
        return True
    row = {j: j for j in range(min(bound, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - bound), min(len(b), i + bound) + 1):
            new[j] = min(row.get(j - 1, bound + 1) + (j > 0 and x != b[j - 1]) if j else bound + 1, row.get(j, bound + 1) + 1, new.get(j - 1, bound + 1) + 1)
        row = new
    return row.get(len(b), bound + 1) <= bound


ASKED = "_block int, kind int, key long, more int, doc long, line long"


def requests(block: int, kind: int, key: np.ndarray, more: np.ndarray, doc: np.ndarray, line: np.ndarray) -> pa.Table:
    n = len(key)
    return pa.table({"_block": np.full(n, block, np.int32), "kind": np.full(n, kind, np.int32), "key": key.view(np.int64), "more": more.view(np.int32), "doc": doc, "line": line})


def of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.compute.equal(table["kind"], kind))


def dedup_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", min_exact: int | None = None, bound: int = 1, prefix: str = "") -> DataFrame:
    """The documents' rows and columns, the text without near-repeated lines, and n_lines, n_removed_lines (long).

    A line, stripped of ASCII white space, with at least min_chars characters goes if an earlier such line, by
    (id, number in its text), is equal or within `bound` edits (a character more, less or other each). Lines are judged
    on the input. Shorter lines stay, as do rows without an id or a text. With min_exact, shorter lines with at least so
    many characters (1: all that aren't blank) go if an earlier line is equal. Ids may be of any type that has an order; rows
    with one id are in no order among themselves, but lines count by their number. Columns of the documents named n_lines or
    n_removed_lines are replaced; these names begin with prefix.

    1. Equal lines meet by their hash: a block asks once for each distinct line and is told the earliest. Of lines
    within one edit one half is equal, so it asks for halves too, and is told those that two lines have. 2. The
    earliest of equal lines, if some other line has a half of it, sends all its variants within the bound as hashed keys (with a
    bound over one, whose variants are many, whatever its halves). 3. Equal variants meet, and each block is told of
    the earliest line of each: minima only, never pairs, so a template with very many fillings is no group to compare. 4.
    The line goes to the block of the earlier one, which verifies the edit distance. 5. Lines are cut from the texts.
    """
    min_exact = min_chars if min_exact is None else min(min_chars, min_exact)
    blocks = Blocks(docs, id_col, text_col)
    own_id, first = F.struct("doc", "line"), F.min(F.struct("doc", "line")).over(Window.partitionBy("kind", "key", "more"))

    def meet(asked: DataFrame, what: str) -> DataFrame:
        """(_block, kind, key, more, doc, line, ahead): entries that have an earlier one; of halves those that two lines have, for
        which doc and line are the least and greatest hash; local finds as they are."""
        key = Window.partitionBy("kind", "key", "more")
        met = asked.repartition(blocks.tasks, "kind", "key", "more").withColumn("ahead", first).withColumn("_least", F.min("doc").over(key)).withColumn("_most", F.max("line").over(key))
        told = F.when(F.col("kind") == HALF, F.col("_least") != F.col("_most")).when(F.col("kind") == LOCAL, True).otherwise(F.col("ahead") < own_id)
        return staged(met.where(told).drop("_least", "_most"), what)

    def look(block: int, row: dict) -> pa.Table:
        lines = Lines(row["rows"], min_chars, min_exact)
        out = [requests(block, EXACT, lines.key, lines.more, lines.first_doc, lines.first_at)]
        if bound == 1:
            keys, low, high, _ = lines.halves()
            out.append(requests(block, HALF, keys, np.zeros(len(keys), np.uint32), low, high))
        return pa.concat_tables(out)

    def spread(block: int, row: dict, replies: pa.Table) -> pa.Table:
        """The variants of the block's lines that are the earliest of equal ones; and lines that are within the bound of an
        earlier one of the block itself."""
        lines = Lines(row["rows"], min_chars, min_exact)
        known = of_kind(replies, EXACT)
        place = places_of(lines.key, lines.more, known["key"].to_numpy().view(np.uint64), known["more"].to_numpy().view(np.uint32))
        mine = (place < 0) & lines.long
        if bound == 1:
            halves, _, _, at = lines.halves()
            shared = np.zeros((len(lines.strings), 4), bool)
            shared[lines.long] = np.isin(halves, of_kind(replies, HALF)["key"].to_numpy().view(np.uint64))[at]
            chosen = np.flatnonzero(mine & shared.any(axis=1))
            owner, key, more = lines.variants_within_one(chosen, shared[chosen, 2:].any(axis=1), shared[chosen, :2].any(axis=1))
        else:
            owner, key, more = lines.variants(np.flatnonzero(mine), bound)
        doc, line = lines.first_doc[owner], lines.first_at[owner]
        at, which = grouped(key, more, doc, line)
        out = [requests(block, VARIANT, key[at], more[at], doc[at], line[at])]
        later = np.flatnonzero(owner[at][which] != owner)
        n = max(1, len(lines.strings))
        pairs = np.unique(owner[later] * n + owner[at][which[later]]).tolist()
        near = sorted({x // n for x in pairs if within(lines.strings[x // n], lines.strings[x % n], bound)})
        out.append(requests(block, LOCAL, lines.key[near], lines.more[near], lines.first_doc[near], lines.first_at[near]))
        return pa.concat_tables(out)

    def fetch(block: int, row: dict, pairs: pa.Table) -> pa.Table:
        """The texts of lines, for the blocks of the earlier ones."""
        texts = texts_of(row["rows"], {d for d in pairs["doc"].to_pylist()})
        pairs = pairs.to_pylist()
        out = [(p, x) for p in pairs for x in texts.get((p["doc"], p["line"]), ())]
        return pa.table({"_block": pa.array(blocks.block_of(p["ahead"]["doc"] for p, _ in out), pa.int32()), "home": pa.array([block] * len(out), pa.int32()), "kept_doc": pa.array([p["ahead"]["doc"] for p, _ in out], pa.int64()), "kept_line": pa.array([p["ahead"]["line"] for p, _ in out], pa.int64()), "doc": pa.array([p["doc"] for p, _ in out], pa.int64()), "line": pa.array([p["line"] for p, _ in out], pa.int64()), "text": pa.array([x for _, x in out], pa.string())})

    def verify(block: int, row: dict, asked: pa.Table) -> pa.Table:
        texts = texts_of(row["rows"], set(asked["kept_doc"].to_pylist())) if len(asked) else {}
        found = [r for r in asked.to_pylist() if any(within(x, r["text"], bound) for x in texts.get((r["kept_doc"], r["kept_line"]), ()))]
        return pa.table({"_block": pa.array([r["home"] for r in found], pa.int32()), "doc": pa.array([r["doc"] for r in found], pa.int64()), "line": pa.array([r["line"] for r in found], pa.int64())})

    def cut(block: int, row: dict, replies: pa.Table) -> pa.Table:
        lines = Lines(row["rows"], min_chars, min_exact)
        known, near = of_kind(replies, EXACT), of_kind(replies, LOCAL)
        elsewhere = places_of(lines.key, lines.more, known["key"].to_numpy().view(np.uint64), known["more"].to_numpy().view(np.uint32)) >= 0
        if len(lines.which):
            gone = elsewhere[lines.which] | (lines.first_doc[lines.which] != lines.doc) | (lines.first_at[lines.which] != lines.at)
        else:
            gone = np.zeros(0, bool)
        close, cuts = set(zip(near["doc"].to_pylist(), near["line"].to_pylist(), strict=True)), {}
        for d, n, g in zip(lines.doc.tolist(), lines.at.tolist(), gone.tolist(), strict=True):
            if g or (d, n) in close:
                cuts.setdefault(d, set()).add(n)
        texts, counts, removed = [], [], []
        for who, raw, text in zip(lines.ids, lines.table["t"], lines.texts, strict=True):
            own = {n for n in cuts.get(who, ()) if n < len(text) and len(text[n].strip().decode("utf-8", "replace")) >= min_exact} if text is not None and who is not None else ()
            counts.append(0 if text is None else len(text))
            removed.append(len(own))
            texts.append(b"\n".join(x for n, x in enumerate(text) if n not in own) if own else raw.as_py())
        return blocks.out(lines.table, texts, _lines=pa.array(counts, pa.int64()), _removed=pa.array(removed, pa.int64()))

    equal = meet(blocks.ask(look, ASKED), "equal-lines")
    told = equal.where(F.col("kind") == EXACT).select("_block", "kind", "key", "more", "doc", "line")
    if bound:
        near = meet(blocks.ask(spread, ASKED, equal.select("_block", "kind", "key", "more")), "near-lines")
        pairs = near.where(F.col("kind") == VARIANT).groupBy("_block", "doc", "line").agg(F.min("ahead").alias("ahead"))
        texts = blocks.ask(fetch, "_block int, home int, kept_doc long, kept_line long, doc long, line long, text string", pairs)
        verified = staged(blocks.ask(verify, "_block int, doc long, line long", texts), "verified-lines")
        nothing = [F.lit(0).cast("long").alias("key"), F.lit(0).alias("more")]
        local = near.where(F.col("kind") == LOCAL).select("_block", "doc", "line").union(verified)
        told = told.union(local.select("_block", F.lit(LOCAL).alias("kind"), *nothing, "doc", "line"))
    out = blocks.ask(cut, blocks.schema("_lines long, _removed long"), told)
    return blocks.restore(out, {"_lines": prefix + "n_lines", "_removed": prefix + "n_removed_lines"})


def texts_of(rows: bytes, wanted: set[int]) -> dict[tuple[int, int], list[str]]:
    """The stripped lines of some rows of a block, by (id, number); of rows with one id each has its own."""
    if not wanted:
        return {}
    table, out = unframed(rows), {}
    for who, text in zip(table["i"].to_pylist(), table["t"], strict=True):
        if who in wanted and text.is_valid:
            for n, line in enumerate(text.as_py().split(b"\n")):
                out.setdefault((who, n), []).append(line.strip().decode("utf-8", "replace"))
    return out


def op4_lines(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, k::INTEGER AS k, trim(ls[k + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM (SELECT doc_id, ls, unnest(generate_series(0, len(ls) - 1)) AS k FROM raw)),
e AS (SELECT * FROM l WHERE length(s) >= 20),
f AS (SELECT s, min({'d': doc_id, 'k': k}) AS o FROM e GROUP BY s),
v AS (SELECT s, o, length(s) AS n, unnest(generate_series(1, length(s))) AS p FROM f),
del AS (SELECT s, o, n, p, substr(s, 1, p - 1) || substr(s, p + 1) AS x FROM v),
sw AS (SELECT s, min(o) OVER (PARTITION BY x, n, p) AS w FROM del),
dr AS (SELECT DISTINCT del.s, f.s AS x, del.o AS so, f.o AS xo FROM del JOIN f ON del.x = f.s),
w AS (SELECT s, w FROM sw UNION ALL SELECT s, xo FROM dr UNION ALL SELECT x, so FROM dr),
b AS (SELECT s, min(w) AS w FROM w GROUP BY s),
g AS (SELECT e.doc_id, e.k FROM e JOIN f USING (s) LEFT JOIN b USING (s) WHERE f.o < {'d': e.doc_id, 'k': e.k} OR b.w < {'d': e.doc_id, 'k': e.k}),
r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id)
SELECT documents.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed_lines,
  sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(ls, generate_series(0, len(ls) - 1)), lambda x: gone IS NULL OR NOT list_contains(gone, x[2])), lambda x: x[1]), chr(10)), '')) AS kept_sha256
FROM documents LEFT JOIN raw USING (doc_id) LEFT JOIN r ON r.doc_id = documents.doc_id
"""
