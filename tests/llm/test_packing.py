import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gneiss.llm.packing import Plan, op8_packing, pack_best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, size, end):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for who, all_texts in texts.items():
        pieces, at = sorted(by_doc[who], key=lambda r: (r["piece"], r["start"])), 0
        if len(all_texts) > 1:
            continue
        ids = np.array([*own.encode(all_texts[0] or "", add_special_tokens=False).ids, end], "<u4")
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and zlib.crc32(ids[at : at + r["length"]]) == r["ids_crc32"]
            assert k == 0 or r["length"] == size
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), sum(r["length"] for r in rows)


def test_odd_rows(odd):
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(r["text"])
    rows = pack_best_fit(odd, PATH, public_tokenizers.PATTERN, size=100, end_id=0).collect()
    check(rows, texts, 100, 0)
    assert sum(r["doc_id"] == 7 for r in rows) == 2 * sum(r["doc_id"] is None for r in rows)
    assert pack_best_fit(odd.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plans(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 100, 512])
    counts = dict(Counter(min(size, 1 + int(rng.expovariate(1 / rng.choice([3, 40, 200])))) for _ in range(rng.choice([0, 1, 50, 3000]))))
    plan = Plan(counts, size, groups=rng.choice([4, 20, 512]))
    held = Counter()
    for bins, content in plan.runs:
        assert bins > 0 and sum(n * k for n, k in content) <= size
        for n, k in content:
            held[n] += bins * k
    assert dict(held) == counts
    covered = defaultdict(list)
    for n, a, b, *_ in plan.places():
        covered[n].append((a, b))
    for n, c in counts.items():
        ends = sorted(covered[n])
        assert ends[0][0] == 0 and ends[-1][1] == c and all(x[1] == y[0] for x, y in zip(ends, ends[1:], strict=False))


def optimal(items, size):
    """The fewest bins, by trying every place for each item."""

    def fits(rest, rooms):
        if not rest:
            return True
        return any(fits(rest[1:], [*rooms[:k], rooms[k] - rest[0], *rooms[k + 1 :]]) for k in range(len(rooms)) if rooms[k] >= rest[0] and rooms[k] not in rooms[:k])

    items, bins = sorted(items, reverse=True), -(-sum(items) // size)
    while not fits(items, [size] * bins):
        bins += 1
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_near_an_optimal_packing(seed):
    rng = random.Random(seed)
    size = rng.choice([20, 64])
    items = [rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 10))]
    best, own = optimal(items, size), lambda groups: sum(n for n, _ in Plan(dict(Counter(items)), size, groups).runs)
    assert best <= own(12) <= best + 1 and own(2) <= 2 * best + 1


def test_lengths_are_grouped_whatever_their_number():
    counts = {n: 3 for n in range(30, 90)}
    groups = Plan._groups(sorted(counts.items(), reverse=True), 12)
    assert len(groups) == 12 and {sum(c for _, c in g) for g in groups} == {15}
    rng = random.Random(3)
    for pieces in (300, 30_000):
        counts = Counter(min(2048, 1 + int(rng.expovariate(1 / 800))) for _ in range(pieces))
        runs, least = Plan(dict(counts), 2048).runs, -(-sum(n * c for n, c in counts.items()) // 2048)
        assert sum(n for n, _ in runs) <= 1.01 * least + 1
        used = {tuple(sorted(n for n, k in held for _ in range(k) if 512 < n < 2048)) for _, held in runs}
        assert len(used) > 12


def test_whole_table(spark, sf):
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sequences, tokens = check(op8_packing(spark, sf).collect(), texts, 2048, 0)
    assert sequences <= 1.01 * -(-tokens // 2048) + 1
