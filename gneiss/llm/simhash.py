"""SimHash near-dedup: exact tiled comparison of fingerprints, links contracted to groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import SALTS, components, local_forest, look_up, mix, n_parts, salt, small, staged

#: A fingerprint's 64 bits fall into this many parts; a tile holds the fingerprints whose parts have the same bit counts.
PARTS = 4
#: Most fingerprints of a tile that one task compares, and most that it compares them with.
HOME, GUESTS = 8192, 1 << 18
#: Numbers of 64 bits in the SimHash of a set.
WIDE = 4
#: Sets of a group of candidates that one task verifies against as many others.
VERIFIED = 2048


def fingerprint(text: bytes | None, shingle: int, chunk: int = 1 << 16) -> int:
    """The SimHash of a text: bit b is set if over half of the shingles' XXH64 values have it."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    raw = b" ".join(words)
    size = min(shingle, len(words))
    n = len(words) - size + 1
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    ends, starts = (starts[size : size + n] - 1).tolist(), starts[:n].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, chunk):
        h = np.array([digest(raw[a:b], 42) for a, b in zip(starts[k : k + chunk], ends[k : k + chunk], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) of each row: A-Z lower-cased, words split at ASCII white space, shingles with repeats,
    joined by a space; fewer words than a shingle are one shingle, and no words (null, empty) give zero."""

    def compute(batches):
        for batch in batches:
            out = [fingerprint(x, shingle) for x in batch["_text"].to_pylist()]
            yield pa.record_batch({"_id": batch["_id"], "fingerprint": pa.array(out, pa.int64())})

    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    return own.mapInArrow(compute, f"_id {docs.schema[id_col].dataType.simpleString()}, fingerprint long").withColumnRenamed("_id", id_col)


def tile_of(x: np.ndarray) -> np.ndarray:
    """The bit counts of each part, as digits of one number."""
    width = 64 // PARTS
    tile = np.zeros(len(x), np.int64)
    for k in range(PARTS):
        tile = tile * (width + 1) + np.bitwise_count((x >> np.uint64(width * k)) & np.uint64((1 << width) - 1)).astype(np.int64)
    return tile


def near_tiles(radius: int) -> list[tuple[int, int]]:
    """(step, total) to the tiles before a tile whose bit counts differ by no more than radius in all."""
    base, steps = 64 // PARTS + 1, [((), 0)]
    for _ in range(PARTS):
        steps = [((*s, d), t + abs(d)) for s, t in steps for d in range(-radius, radius + 1) if t + abs(d) <= radius]
    return sorted({sum(d * base ** (PARTS - 1 - k) for k, d in enumerate(s)): s for s, _ in steps if s < (0,) * PARTS}.items())


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fingerprint) that join all those within radius bits.

    Two numbers within radius bits have bit counts that differ by no more than radius in total over the parts, so a
    tile is compared with itself and the tiles before it within that distance, by exclusive-or and bit counts, and all
    other tile pairs are skipped. A tile's task gives a forest, not all pairs. Tiles with many fingerprints or many
    neighbours are compared by several tasks, each with a share. The tile counts that all tasks get are at most
    (64 / PARTS + 1) ** PARTS numbers, 83,521, whatever the input.
    """
    spark = distinct.sparkSession
    parts, width = n_parts(spark), 64 // PARTS
    part_counts = [F.bit_count(F.shiftrightunsigned("fingerprint", width * k).bitwiseAND(F.lit((1 << width) - 1))) for k in range(PARTS)]
    tile = sum((c.cast("long") * (width + 1) ** (PARTS - 1 - k) for k, c in enumerate(part_counts)), F.lit(0))
    counts = distinct.groupBy(tile.alias("tile")).count().collect()
    n_tiles = (width + 1) ** PARTS
    size = np.zeros(n_tiles, np.int64)
    for row in counts:
        size[row["tile"]] = row["count"]
    steps = [(s, d) for s, d in near_tiles(radius)]
    digits = [np.arange(n_tiles) // (width + 1) ** (PARTS - 1 - k) % (width + 1) for k in range(PARTS)]

    def neighbour(tiles: np.ndarray, step: int, d: tuple[int, ...]) -> np.ndarray:
        """The tile at this step, or -1 where there is none with fingerprints."""
        ok = np.ones(len(tiles), bool)
        for k in range(PARTS):
            own = digits[k][tiles] + d[k]
            ok &= (own >= 0) & (own <= width)
        to = np.where(ok, tiles + step, 0)
        return np.where(ok & (size[to] > 0), to, -1)

    present = np.flatnonzero(size)
    guests = size.copy()
    for step, d in steps:
        to = neighbour(present, step, d)
        np.add.at(guests, to[to >= 0], size[present[to >= 0]])
    homes_of, shares_of = -(-size // HOME), -(-guests // GUESTS)
    homes_of, shares_of = np.maximum(homes_of, 1).astype(np.int32), np.maximum(shares_of, 1).astype(np.int32)

    def deal(batches):
        for batch in batches:
            x = batch["fingerprint"].to_numpy(zero_copy_only=False).view(np.uint64)
            own, mixed = tile_of(x), (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            unit, who, home = [], [], []
            for share in range(int(shares_of[own].max(initial=0))):
                take = share < shares_of[own]
                unit.append(np.stack([own[take], (mixed[take] % homes_of[own[take]].astype(np.uint64)).astype(np.int64), np.full(int(take.sum()), share)]))
                who.append(x[take])
                home.append(np.ones(int(take.sum()), bool))
            for step, d in [(0, (0,) * PARTS), *steps]:
                to = neighbour(own, step, d)
                for h in range(int(homes_of[to[to >= 0]].max(initial=0))):
                    take = (to >= 0) & (h < homes_of[to])
                    unit.append(np.stack([to[take], np.full(int(take.sum()), h), (mixed[take] // np.uint64(64) % shares_of[to[take]].astype(np.uint64)).astype(np.int64)]))
                    who.append(x[take])
                    home.append(np.zeros(int(take.sum()), bool))
            if not unit:
                continue
            unit, who, home = np.concatenate(unit, axis=1), np.concatenate(who), np.concatenate(home)
            order = np.lexsort((home, unit[2], unit[1], unit[0]))
            unit, who, home = unit[:, order], who[order], home[order]
            new = np.ones(len(who), bool)
            new[1:] = (np.diff(unit, axis=1) != 0).any(axis=0) | (home[1:] != home[:-1])
            at = np.flatnonzero(new)
            ends = np.append(at[1:], len(who)).tolist()
            yield pa.record_batch({"tile": pa.array(unit[0][at], pa.int64()), "h": pa.array(unit[1][at], pa.int32()), "g": pa.array(unit[2][at], pa.int32()), "home": pa.array(home[at]), "xs": pa.array([who[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        home, xs = table["home"].to_pylist(), table["xs"].to_pylist()
        a = np.frombuffer(b"".join(x for x, h in zip(xs, home, strict=True) if h), np.uint64)
        b = np.frombuffer(b"".join(x for x, h in zip(xs, home, strict=True) if not h), np.uint64)
        nodes, which = np.unique(np.concatenate([a, b]), return_inverse=True)
        ia, ib, low = which[: len(a)], which[len(a) :], np.arange(len(nodes))
        rows = max(1, (1 << 21) // max(1, len(b)))
        for k in range(0, len(a), rows):
            i, j = np.nonzero(np.bitwise_count(a[k : k + rows, None] ^ b[None, :]) <= radius)
            low = local_forest(len(nodes), ia[k + i], ib[j], low)
        linked = np.flatnonzero(low != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[linked].view(np.int64)), "b": pa.array(nodes[low[linked]].view(np.int64))})

    dealt = distinct.select("fingerprint").mapInArrow(deal, "tile long, h int, g int, home boolean, xs binary")
    return dealt.repartition(parts, "tile", "h", "g").groupBy("tile", "h", "g").applyInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long, component_id): fingerprints link at radius or fewer differing bits; component_id is the
    smallest id that can be reached, the row's own included.

    Equal fingerprints are one node, so copies cost nothing in the comparison. Rows without an id get the component of
    their fingerprint and don't name one; a component of such rows alone is null. Repeated ids give a row each.
    """
    own = staged(fingerprints(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "_id"), "fingerprints")
    by_salt = own.groupBy("fingerprint", salt("_id").alias("_salt")).agg(F.min("_id").alias("low"))
    distinct = by_salt.groupBy("fingerprint").agg(F.min("low").alias("low"))
    found = components(near_links(distinct, radius))
    roots = distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "low", F.coalesce("root", "fingerprint").alias("root"))
    least = roots.groupBy("root", F.pmod("fingerprint", F.lit(SALTS)).alias("_salt")).agg(F.min("low").alias("low")).groupBy("root").agg(F.min("low").alias("component_id"))
    table = look_up(roots.select("fingerprint", "root"), "root", least, "fingerprint").select("fingerprint", "component_id")
    out = look_up(own, "fingerprint", table, "_id")
    return out.select(F.col("_id").alias(id_col), "fingerprint", "component_id")


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The XXH64 values of a text's different shingles, sorted; words and shingles as fingerprints has them."""
    import xxhash

    words = (text or b"").lower().split()
    raw, size, digest = b" ".join(words), min(shingle, len(words)), xxhash.xxh64_intdigest
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    n = len(words) - size + 1 if words else 0
    ends, starts = (starts[size : size + n] - 1).tolist(), starts[:n].tolist()
    return np.unique(np.array([digest(raw[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64))


def sketch(hashes: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """The SimHash of a set in WIDE numbers of 64 bits, from as many mixes of each hash."""
    seeds, counts = np.arange(WIDE, dtype=np.uint64) << np.uint64(32), np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(hashes), chunk):
        mixed = mix(hashes[k : k + chunk, None] ^ seeds)
        counts += np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(np.uint64)


def most_bits(bits: int, least: float, deviations: float) -> int:
    """A radius for sets with a Jaccard similarity of `least`: the bits expected to differ, and some standard deviations."""
    p = np.arccos(2 * least / (1 + least)) / np.pi
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def near_sketches(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): sets of sizes na and nb with sketches (columns of a and b) near enough for a similarity of least."""
    i, j = np.nonzero(np.bitwise_count(a[0][:, None] ^ b[0][None, :]) <= most_bits(64, least, 4.5))
    fit = np.minimum(na[i], nb[j]) >= least * np.maximum(na[i], nb[j])
    i, j = i[fit], j[fit]
    fit = sum(np.bitwise_count(a[k][i] ^ b[k][j]).astype(np.int64) for k in range(WIDE)) <= most_bits(64 * WIDE, least, 5)
    return i[fit], j[fit]


def near_set_links(distinct: DataFrame, least: float) -> DataFrame:
    """(a, b): links among nodes (node, n, s0 to s3) that join all those near_sketches finds.

    Sets that similar have sizes within a factor of 1 / least, so a band of sizes, each a factor of 1 / least wide, is
    compared with itself and the band below. As in near_links a task gives a forest, and bands with many nodes are
    compared by several tasks. Band counts are as many as powers of 1 / least in the longest text, below 200.
    """
    spark = distinct.sparkSession
    names = [f"s{k}" for k in range(WIDE)]
    width = float(-np.log(least)) * (1 + 1e-9)
    banded = distinct.select("node", "n", *names, F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / width).cast("int").alias("band"))
    counts = {r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}
    homes = {b: max(1, -(-c // HOME)) for b, c in counts.items()}
    shares = {b: max(1, -(-(c + counts.get(b - 1, 0)) // GUESTS)) for b, c in counts.items()}

    def deal(batches):
        for batch in batches:
            band = batch["band"].to_numpy(zero_copy_only=False)
            mixed = mix(batch["node"].to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(1)
            for own in np.unique(band).tolist():
                at = np.flatnonzero(band == own)
                for to in (own, own + 1):
                    if to not in counts:
                        continue
                    h, g = (mixed[at] % np.uint64(homes[to])).astype(np.int32), (mixed[at] // np.uint64(1 << 20) % np.uint64(shares[to])).astype(np.int32)
                    sides = [(np.full(len(at), x, np.int32), g, False) for x in range(homes[to])]
                    if to == own:
                        sides += [(h, np.full(len(at), x, np.int32), True) for x in range(shares[to])]
                    for x, y, home in sides:
                        rows = batch.select(["node", "n", *names]).take(pa.array(at))
                        yield pa.record_batch([pa.array(np.full(len(at), to, np.int32)), pa.array(x), pa.array(y), pa.array(np.full(len(at), home)), *rows.columns], names=["band", "h", "g", "home", "node", "n", *names])

    def compare(table: pa.Table) -> pa.Table:
        home = table["home"].to_numpy()
        node, n, s = table["node"].to_numpy(), table["n"].to_numpy(), [table[x].to_numpy().view(np.uint64) for x in names]
        a, b = np.flatnonzero(home), np.flatnonzero(~home)
        nodes, which = np.unique(node, return_inverse=True)
        low, to = np.arange(len(nodes)), [x[b] for x in s]
        rows = max(1, (1 << 21) // max(1, len(b)))
        for k in range(0, len(a), rows):
            part = a[k : k + rows]
            i, j = near_sketches([x[part] for x in s], n[part], to, n[b], least)
            low = local_forest(len(nodes), which[part][i], which[b][j], low)
        linked = np.flatnonzero(low != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[linked]), "b": pa.array(nodes[low[linked]])})

    columns = ", ".join(f"{x} long" for x in names)
    dealt = banded.mapInArrow(deal, f"band int, h int, g int, home boolean, node long, n int, {columns}")
    return dealt.repartition(n_parts(spark), "band", "h", "g").groupBy("band", "h", "g").applyInArrow(compare, "a long, b long")


def similar_sets(nodes: list[int], sets: list[np.ndarray], least: float, second: list[bool] | None = None) -> list[tuple[int, int]]:
    """(node, root) of the nodes that links of an exact Jaccard similarity of least or more join to a smaller one. Pairs that
    are joined already are not verified, and with second, which says what half a node is in, neither are pairs of one half."""
    order = np.argsort(np.array(nodes, np.int64))
    nodes, sets = [nodes[k] for k in order], [sets[k] for k in order]
    half = None if second is None else np.array(second)[order]
    size, s, low = np.array([len(x) for x in sets]), np.stack([sketch(x) for x in sets]).T, np.arange(len(nodes))
    for k in range(len(nodes)):
        _, near = near_sketches(s[:, k : k + 1], size[k : k + 1], s[:, k + 1 :], size[k + 1 :], least)
        for j in (near + k + 1).tolist():
            if low[k] == low[j] or half is not None and half[k] == half[j]:
                continue
            both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
            if both >= least * (size[k] + size[j] - both):
                low[low == max(low[k], low[j])] = min(low[k], low[j])
    return [(nodes[k], nodes[x]) for k, x in enumerate(low.tolist()) if x != k]


def similar_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of rows with an id: texts link whose sets of shingles have a Jaccard similarity of least or
    more; component_id is the smallest id that can be reached, the row's own included.

    Equal sets are one node. Wide SimHashes of the sets are compared at a radius that pairs with a similarity of least
    exceed once in some ten thousand; what they join is a group of candidates. A group's sets are dealt into parts of
    VERIFIED sets at most on average, and each pair of parts meets in a task, which verifies near pairs by their exact
    similarity: so a task holds two parts, at 8 bytes a shingle, however large the group.
    """
    names = [f"s{k}" for k in range(WIDE)]
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text")).where("_id IS NOT NULL")

    def node_of(hashes: np.ndarray) -> int:
        import xxhash

        return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))

    def compute(batches):
        for batch in batches:
            sets = [shingle_hashes(x, shingle) for x in batch["_text"].to_pylist()]
            s = np.stack([sketch(x) for x in sets]).view(np.int64) if sets else np.zeros((0, WIDE), np.int64)
            yield pa.record_batch([batch["_id"], pa.array([node_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), *(pa.array(s[:, k].copy()) for k in range(WIDE))], names=["_id", "node", "n", *names])

    def whole(batches):
        for batch in batches:
            sets = [shingle_hashes(x, shingle) for x in batch["_text"].to_pylist()]
            yield pa.record_batch({"node": pa.array([node_of(x) for x in sets], pa.int64()), "set": pa.array([x.tobytes() for x in sets], pa.binary())})

    def verify(batches):
        unit, held = None, {}
        for batch in batches:
            for top, x, y, g, node, raw in zip(*(batch[c].to_pylist() for c in ("top", "x", "y", "g", "node")), batch["set"], strict=True):
                if (top, x, y) != unit and held:
                    yield linked(held, unit)
                    held = {}
                unit = top, x, y
                held[node] = g != x, np.frombuffer(raw.as_py(), np.uint64)
        if held:
            yield linked(held, unit)

    def linked(held, unit):
        out = similar_sets(list(held), [s for _, s in held.values()], least, None if unit[1] == unit[2] else [h for h, _ in held.values()])
        return pa.record_batch({"node": pa.array([a for a, _ in out], pa.int64()), "root": pa.array([b for _, b in out], pa.int64())})

    own = staged(texts.mapInArrow(compute, f"_id {kind}, node long, n int, " + ", ".join(f"{x} long" for x in names)), "sketches")
    by_salt = own.groupBy("node", salt("_id").alias("_salt")).agg(F.min("_id").alias("low"), *(F.min(x).alias(x) for x in ("n", *names)))
    distinct = staged(by_salt.groupBy("node").agg(F.min("low").alias("low"), *(F.min(x).alias(x) for x in ("n", *names))), "sets")
    candidates = components(near_set_links(distinct, least)).withColumnRenamed("root", "top")
    wanted = staged(distinct.join(candidates, "node").select("node", "top", F.col("low").alias("_id")), "candidates")
    sets = texts.join(small(wanted.select("_id").distinct()), "_id", "left_semi").mapInArrow(whole, "node long, set binary")
    sizes = wanted.groupBy("top", salt("node").alias("_salt")).count().groupBy("top").agg(F.ceil(F.sum("count") / VERIFIED).cast("int").alias("parts"))
    dealt = look_up(wanted.select("node", "top"), "top", sizes, "node").withColumn("g", F.pmod(F.xxhash64(F.lit("part"), "node"), "parts").cast("int"))
    dealt = staged(dealt.select("node", "top", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")), "parts")
    groups = sets.join(small(dealt.select("node", "top", "g", F.least("g", "other").alias("x"), F.greatest("g", "other").alias("y"))), "node")
    unit = ["top", "x", "y"]
    found = staged(groups.repartition(n_parts(docs.sparkSession), *unit).sortWithinPartitions(*unit).mapInArrow(verify, "node long, root long"), "similar")
    if not dealt.where("g <> other").isEmpty():  # parts of a group know some of its links each
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = distinct.join(found, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    least_id = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    table = roots.join(least_id, "root").select("node", "component_id")
    return look_up(own.select("_id", "node"), "node", table, "_id").select(F.col("_id").alias(id_col), "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
