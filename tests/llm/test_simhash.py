import random
import re

import pytest
import xxhash

from gneiss.llm import simhash
from tests.llm.test_common import roots


def plain(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    x = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return x - (1 << 64) if x >> 63 else x


def groups(rows, radius=3):
    prints = [(i, plain(t, 3)) for i, t in rows]
    near = [(a[0], b[0]) for n, a in enumerate(prints) for b in prints[:n] if ((a[1] ^ b[1]) & (2**64 - 1)).bit_count() <= radius]
    root = roots([e for e in near if e[0] != e[1]])
    return sorted((i, x, root.get(i, i)) for i, x in prints)


def found(df):
    return sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect())


def test_odd_rows(odd):
    known = odd.where("doc_id IS NOT NULL")
    assert found(known) == groups([(r["doc_id"], r["text"]) for r in known.collect()])
    out = {r["doc_id"]: r for r in simhash.simhash_groups(odd).collect()}
    assert out[1]["fingerprint"] == 0 and out[3]["component_id"] == 1 and out[None]["component_id"] == 7
    assert simhash.simhash_groups(odd).count() == odd.count() and simhash.simhash_groups(odd.limit(0)).count() == 0


def test_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op10_simhash(spark, sf).collect())
    assert got == [(i, f"{x % 2**64:016x}", c) for i, x, c in groups(rows)]


@pytest.mark.parametrize("home, guests", [(8192, 1 << 18), (3, 5)])
def test_links_join_all_pairs_within_the_radius(spark, monkeypatch, home, guests):
    monkeypatch.setattr(simhash, "HOME", home)
    monkeypatch.setattr(simhash, "GUESTS", guests)
    rng = random.Random(8)
    xs = {rng.getrandbits(64) for _ in range(30)} | {0, 2**64 - 1}
    for x in list(xs):
        for _ in range(8):
            y = x
            for _ in range(rng.randrange(1, 6)):
                y ^= 1 << rng.randrange(64)
            xs.add(y)
    xs = sorted(x - (1 << 64) if x >> 63 else x for x in xs)
    df = spark.createDataFrame([(x,) for x in xs], "fingerprint long").repartition(3)
    links = [(r["a"], r["b"]) for r in simhash.near_links(df, 3).collect()]
    assert len(links) <= 4 * len(xs)
    true = [(a, b) for n, a in enumerate(xs) for b in xs[:n] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert roots(links) == roots(true)


@pytest.mark.parametrize("verified", [2048, 3])
def test_similar_groups_reach_all_similar_texts(documents, monkeypatch, verified):
    monkeypatch.setattr(simhash, "VERIFIED", verified)
    rng, rows = random.Random(9), []
    for k in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice((12, 40, 150, 700)))]
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randrange(1 + len(own) // 35)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (None, rows[0][1])]
    known = [r for r in rows if r[0] is not None]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for _, t in known)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    far = [(a, b) for a, b in pairs if ((plain(known[a][1], 3) ^ plain(known[b][1], 3)) & (2**64 - 1)).bit_count() > 3]
    assert len(far) > 50  # what a radius of 3 bits over 3-word shingles doesn't link
    root = roots(pairs)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(rows)).collect()}
    assert got == {i: root.get(i, i) for i, _ in known}


def test_pipeline_drops_near_copies_at_a_similarity(spark, documents):
    import corpus_pipeline

    words = [f"w{k}" for k in range(400)]
    near, far = list(words), list(words)
    near[50::100] = ["a", "b", "c", "d"]  # 20 shingles of 396 differ
    far[10::20] = [f"x{k}" for k in range(20)]  # 100 differ
    docs = documents([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3]
