"""Best-fit packing by linear grouping: a plan made from the histogram of lengths, carried out by ranks."""

from __future__ import annotations

import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import staged, worker_cache


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable bytes are themselves, the others follow at 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def id_encoder(path: str, pattern: str):
    """A function from a text to its ids as an array, without special tokens.

    Ids are those of the tokenizer file. Where the file is plain byte-level BPE whose merges come in the order of their
    ids, the rank encoder gives the same ids several times as fast and is used; otherwise the file's own encoder is.
    """
    cache = worker_cache()
    if ("ids", path) not in cache:
        import json

        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model, before = byte_letters(), spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        made = [model["vocab"].get(m.replace(" ", "")) for m in merges] if model.get("type") == "BPE" else [None]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer") and None not in made and made == sorted(made) and not model.get("dropout") and not model.get("continuing_subword_prefix")
        if plain:
            import tiktoken

            special = {x["content"] for x in spec.get("added_tokens", [])}
            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            cache["ids", path] = lambda text: fast.encode_to_numpy(text, disallowed_special=())
        else:
            cache["ids", path] = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
    return cache["ids", path]


def best_configuration(sizes: list[int], price: np.ndarray, cost: np.ndarray) -> tuple[float, list[int]]:
    """(gain, groups): the one to three groups whose prices exceed the cost of their filling most. cost[n] is for a bin
    filled up to n. A dynamic program over what is filled by one, two and three."""
    held = [np.full(len(cost), -np.inf)]
    held[0][0], chosen = 0.0, []
    for _ in range(3):
        before, now, who = held[-1], np.full(len(cost), -np.inf), np.zeros(len(cost), np.int64)
        for g, n in enumerate(sizes):
            more = before[: len(cost) - n] + price[g]
            better = more > now[n:]
            now[n:][better], who[n:][better] = more[better], g
        held.append(now)
        chosen.append(who)
    k = int(np.argmax([(v - cost).max() for v in held[1:]]))
    at = int((held[k + 1] - cost).argmax())
    gain, groups = float(held[k + 1][at] - cost[at]), []
    for who in reversed(chosen[: k + 1]):
        groups.append(int(who[at]))
        at -= sizes[groups[-1]]
    return gain, groups


def least_cost(sizes: list[int], demand: list[int], cost: np.ndarray, steps: int = 400) -> list[tuple[list[int], float]]:
    """Which configurations, and how often, meet the demand at the least cost: a linear program by the simplex method, with
    configurations made as they are needed. Any number of steps gives a valid answer, more only a cheaper one."""
    used = [[g] for g in range(len(sizes))]
    rows, costs = np.eye(len(sizes)), cost[sizes]
    for _ in range(steps):
        back = np.linalg.inv(rows.T)
        gain, groups = best_configuration(sizes, costs @ back, cost)
        if gain <= 1e-9:
            break
        row = np.bincount(groups, minlength=len(sizes)).astype(float)
        step, limit = back @ row, np.full(len(sizes), np.inf)
        np.divide(np.maximum(back @ demand, 0), step, out=limit, where=step > 1e-9)
        out = int(limit.argmin())
        used[out], rows[out], costs[out] = groups, row, cost[np.array(sizes)[groups].sum()]
    return list(zip(used, np.linalg.solve(rows.T, demand).tolist(), strict=True))


class Plan:
    """Runs of bins with the same contents: lists of (bins, [(length, times), ...]).

    Lengths over size / 4 are dealt, longest first, into `groups` groups of equal cardinality, however many lengths there
    are, and each is rounded up to its group's longest; lengths of size fill bins alone and are no part of this. Three of
    the few sizes at most fit into a bin, and a linear program chooses configurations of them. Room that a configuration leaves is worth something only if shorter documents can use it: its cost is a bin less the
    share `worth` of its room, where that is `useful` or more. Fractions are rounded down, the few documents left over take
    the longest group and what fills its bin best. Documents of the groups then take the places, and shorter ones go where
    they fit best. Of the plans for the settings below the one with the fewest bins counts.
    """

    #: Least useful room as a share of the size, and what useful room is worth.
    USEFUL, WORTH = (1 / 16, 1 / 8, 3 / 16, 1 / 4), (0.0, 0.5, 0.75, 0.9)

    def __init__(self, counts: dict[int, int], size: int, groups: int = 12):
        self.size, self.small = size, size // 4
        large = sorted(((n, c) for n, c in counts.items() if self.small < n < size), reverse=True)
        small = sorted(((n, c) for n, c in counts.items() if n <= self.small and n < size), reverse=True)
        members = self._groups(large, groups)
        best = None
        for useful in self.USEFUL:
            for worth in self.WORTH:
                self.runs: list[tuple[int, list[tuple[int, int]]]] = [(counts[size], [(size, 1)])] if counts.get(size) else []
                self._large([[list(m) for m in own] for own in members], useful * size, worth)
                self._best_fit(small)
                if best is None or sum(n for n, _ in self.runs) < sum(n for n, _ in best):
                    best = self.runs
        self.runs = best

    @staticmethod
    def _groups(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
        """Equal numbers of documents to a group, longest first: for each its (length, documents). Groups that are rounded up
        to the same length are one."""
        per, members, room = max(1, -(-sum(c for _, c in large) // groups)), [], 0
        for n, c in large:
            while c:
                if not room:
                    members.append([])
                    room = per
                take = min(c, room)
                members[-1].append([n, take])
                room, c = room - take, c - take
        out: list[list[list[int]]] = []
        for own in members:
            if out and out[-1][0][0] == own[0][0]:
                out[-1] += own
            else:
                out.append(own)
        return out

    def _large(self, members: list[list[list[int]]], useful: float, worth: float) -> None:
        """Linear grouping: configurations of the rounded sizes, then the documents in their places."""
        if not members:
            return
        sizes, left = [m[0][0] for m in members], [sum(c for _, c in m) for m in members]
        room = self.size - np.arange(self.size + 1)
        for groups, share in least_cost(sizes, left, 1 - worth * np.where(room >= useful, room, 0) / self.size):
            config = [(g, groups.count(g)) for g in sorted(set(groups))]
            n = min(int(max(share, 0) + 1e-6), *(left[g] // k for g, k in config))
            for g, k in config:
                left[g] -= k * n
            self._substitute(config, n, members)
        while any(left):
            config = self._configuration(sizes, left)
            n = min(left[g] // k for g, k in config)
            for g, k in config:
                left[g] -= k * n
            self._substitute(config, n, members)

    def _configuration(self, sizes: list[int], left: list[int]) -> list[tuple[int, int]]:
        """The longest group left, and the one or two others that fill its bin best."""
        there = np.array([g for g, n in enumerate(left) if n])
        first, room = int(there[0]), self.size - sizes[there[0]]
        best, used = 0, [first]
        for k in (1, 2):
            for others in combinations_with_replacement(there.tolist(), k):
                filled = sum(sizes[g] for g in others)
                if best < filled <= room and all([first, *others].count(g) <= left[g] for g in others):
                    best, used = filled, [first, *others]
        return sorted((g, used.count(g)) for g in set(used))

    def _substitute(self, config: list[tuple[int, int]], times: int, members: list[list[list[int]]]) -> None:
        """Puts the group's documents in the places of a configuration, as many bins alike at a time as there can be."""
        while times:
            alike = min([times, *(members[g][0][1] // k for g, k in config)])
            held = []
            for g, k in config:
                need = k * max(alike, 1)
                while need:
                    n, c = members[g][0]
                    take = min(c, need)
                    held.append((n, take // max(alike, 1) if alike else take))
                    need -= take
                    members[g][0][1] -= take
                    if not members[g][0][1]:
                        members[g].pop(0)
            self.runs.append((max(alike, 1), held))
            times -= max(alike, 1)

    def _best_fit(self, items: list[tuple[int, int]]) -> None:
        """Short lengths, longest first, each into the fullest bin that has room for it."""
        runs, self.runs = self.runs, []
        rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
        for bins, held in runs:
            rooms.setdefault(self.size - sum(n * k for n, k in held), []).append((bins, held))
        for n, c in items:
            while c:
                room = min((r for r, own in rooms.items() if r >= n and own), default=None)
                bins, held = rooms[room].pop() if room is not None else (-(-c // (self.size // n)), [])
                room = self.size if room is None else room
                each = room // n
                full = min(bins, c // each)
                if full:
                    rooms.setdefault(room - each * n, []).append((full, [*held, (n, each)]))
                    c -= full * each
                if bins > full and c and c < each:
                    rooms.setdefault(room - c * n, []).append((1, [*held, (n, c)]))
                    full, c = full + 1, 0
                if bins > full:
                    rooms.setdefault(room, []).append((bins - full, held))
        self.runs = [run for _, own in sorted(rooms.items()) for run in own]

    def places(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, from, to, bin, times, offset): the documents of a length by rank, the bins from a number on."""
        out, taken, bin_ = [], {}, 0
        for bins, held in self.runs:
            at = 0
            for n, k in held:
                a = taken.get(n, 0)
                out.append((n, a, a + bins * k, bin_, k, at))
                taken[n] = a + bins * k
                at += n * k
            bin_ += bins
        return out


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32, _part, _rank): a rank counts the pieces of a length that one task made."""

    def cut(batches):
        encode, seen, part = id_encoder(tokenizer_path, pattern), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for who, text in zip(batch["_id"], batch["_text"].to_pylist(), strict=True):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                first = (len(ids) - 1) % size + 1
                for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), size)], range(first, len(ids) + 1, size), strict=True)):
                    rows.append((who, piece, a, b - a, zlib.crc32(ids[a:b]), part, int(seen[b - a])))
                    seen[b - a] += 1
            yield pa.record_batch([pa.array([r[0].as_py() for r in rows], batch["_id"].type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), 1))], names=["_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"])

    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return own.mapInArrow(cut, f"_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, _part int, _rank long")


def pack_best_fit(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", groups: int = 12) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes.

    Documents are their ids and end_id; only those longer than size are cut, the first piece being the short one. The
    plan needs the number of pieces of each length only, so at most `size` numbers come to the driver whatever the
    corpus; see Plan for linear grouping, few-size configurations, substitution and best fit. The plan's rows are
    bounded by size and groups and are joined as a broadcast. A piece's rank among the pieces of its length is its rank
    within the task that made it and the number that earlier tasks made: no window ever holds the pieces of a length.

    Null and empty texts are one end_id. Repeated rows are packed each on their own. Sequences are numbered from 0.
    """
    spark = docs.sparkSession
    made = staged(pieces(docs, tokenizer_path, pattern, size, end_id, id_col, text_col), "pieces")
    by_task = made.groupBy("_part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("_part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    plan = spark.createDataFrame(Plan(counts, size, groups).places(), "length long, _from long, _to long, _bin long, _times long, _at long")
    ranked = made.join(before, ["_part", "length"]).withColumn("_k", F.col("_before") + F.col("_rank")).alias("r")
    place = F.col("_k") - F.col("_from")
    out = ranked.join(F.broadcast(plan).alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to")))
    return out.select(F.col("_id").alias(id_col), "piece", "start", F.col("r.length").alias("length"), "ids_crc32", (F.col("_bin") + F.floor(place / F.col("_times"))).cast("long").alias("sequence_id"), (F.col("_at") + F.pmod(place, F.col("_times")) * F.col("r.length")).alias("offset"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
