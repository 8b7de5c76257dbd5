import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from gneiss.llm.quality import quality_rules
from tests.llm import test_lines, test_packing, test_substrings
from tests.llm.test_common import roots

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(odd, spark):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert stage(spark, docs.limit(0), "").count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert {r["doc_id"] for r in docs.collect()} == {None, -4, 7}


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules(docs).where("kept").collect()}
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality"](spark, docs, sf)
    assert {r["doc_id"] for r in first.collect()} == kept
    second = stage["lines"](spark, first, sf)
    assert second.count() == len(kept)
    out = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in out.collect()}
    assert ids <= kept and len(ids) > 0.8 * len(kept)


def corpus(seed):
    """Texts with exact and near copies, passages and lines that several share, boilerplate, junk, nulls and empty ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, passage = [line(6) for _ in range(5)], line(60)
    rows = []
    for k in range(90):
        text = "\n".join([line(rng.randrange(3, 14)) for _ in range(rng.randrange(1, 9))] + rng.sample(shared, rng.randrange(3)) + ["terms of use of the whole site apply"] * (k % 2))
        if k % 9 == 0:
            text = text + "\n" + passage
        if k % 7 == 0 and rows:
            words = rng.choice(rows)[1]
            text = (words or "").replace("a", "b", k % 3)
        if k % 11 == 0 and rows:
            text = (rng.choice(rows)[1] or "")
        rows.append((k * 7 % 90, [None, "", "x y", "spam spam " * 30][k % 4] if k % 13 == 0 else text, "en", rng.choice(["h1", "h1", "h2", None]), 0))
    rng.shuffle(rows)
    return rows


def plain_quality(rows, min_texts=20, enough=corpus_pipeline.ENOUGH_TEXTS):
    normal = lambda x: " ".join(x.lower().split())
    texts, lines = defaultdict(set), defaultdict(set)
    for _, t, _, host, _ in rows:
        texts[host].add(t)
        for x in (t or "").split("\n"):
            if x.split():
                lines[host, normal(x)].add(t)
    frequent = {k for k, own in lines.items() if len(own) > min_texts and (len(own) > 0.1 * len(texts[k[0]]) or len(own) > enough)}
    out = []
    for i, t, _, host, _ in rows:
        words = (t or "").split()
        windows = [tuple(words[p : p + 5]) for p in range(len(words) - 4)]
        twice, at = Counter(windows), set()
        for p, w in enumerate(windows):
            if twice[w] > 1:
                at.update(range(p, p + 5))
        gone = [x for x in (t or "").split("\n") if x.split() and (host, normal(x)) in frequent]
        left = len(words) - sum(len(x.split()) for x in gone)
        if len(words) >= 10 and 100 * len(at) <= 20 * len(words) and left >= 0.5 * len(words):
            out.append((i, "\n".join(x for x in t.split("\n") if not x.split() or (host, normal(x)) not in frequent)))
    return out


def plain_lines(rows):
    """Near lines of 20 characters and more, and equal ones of any length, against all earlier lines."""
    seen, out = [], {}
    for i, t in sorted(rows):
        kept = []
        for x in t.split("\n"):
            s = x.strip(" \t\n\r\v\f")
            if not s or not any(s == y or len(s) >= 20 and len(y) >= 20 and abs(len(s) - len(y)) < 2 and test_lines.distance(s, y) <= 1 for y in seen):
                kept.append(x)
            seen.append(s)
        out[i] = "\n".join(kept)
    return sorted(out.items())


def plain_near(rows):
    sets = {}
    for i, t in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        sets[i] = {tuple(words[p : p + 5]) for p in range(max(1, len(words) - 4))} if words else set()
    links = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    root = roots(links)
    return sorted((i, t) for i, t in rows if root.get(i, i) == i)


@pytest.mark.parametrize("seed", [1, 2])
def test_each_stage_against_brute_force(spark, seed):
    rows = corpus(seed)
    stage = lambda name, rows: sorted((r["doc_id"], r["text"]) for r in STAGE[name](spark, spark.createDataFrame([(i, t, "en", h, 0) for i, t, h in rows], COLUMNS), "").collect())
    hosts = {r[0]: r[3] for r in rows}
    with_host = lambda rows: [(i, t, hosts[i]) for i, t in rows]
    kept = stage("quality", [(i, t, h) for i, t, _, h, _ in rows])
    assert kept == sorted(plain_quality(rows)) and 40 < len(kept) < 90
    shorter = stage("lines", with_host(kept))
    assert shorter == plain_lines(kept) and shorter != kept
    single = stage("near_copies", with_host(shorter))
    assert single == plain_near(shorter)
    assert stage("near_copies", with_host(kept)) == plain_near(kept) != kept
    cut = stage("substrings", with_host(single))
    plain = test_substrings.brute(kept, 50)
    raw = stage("substrings", with_host(kept))
    assert sorted((str(i), " ".join(t.split())) for i, t in raw) == [(i, w) for i, _, _, w in plain] and any(n for _, _, n, _ in plain)
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in cut], COLUMNS)
    sequences, tokens = test_packing.check(STAGE["packing"](spark, docs, "").collect(), {i: [t] for i, t in cut}, 2048, 0)
    assert sequences <= -(-tokens // 2048) + 1 and public_tokenizers.PATTERN
