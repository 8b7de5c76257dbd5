import random

from gneiss.llm.substrings import OP2_SQL, dedup_substrings, levels_of, op2_substrings
from tests.oracle import connection, same


def brute(rows, size):
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - size + 1):
            if i is not None:
                first[tuple(w[p : p + size])] = min(i, first.get(tuple(w[p : p + size]), i))
    out = []
    for i, t in rows:
        w, gone = (t or "").split(), set()
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def found(df, size, **how):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], " ".join((r["text"] or "").split())) for r in dedup_substrings(df, size, **how).collect())


def test_odd_rows(odd):
    ascii_only = odd.where("doc_id IS NULL OR doc_id <> 8")
    assert found(ascii_only, 50) == brute([(r["doc_id"], r["text"]) for r in ascii_only.collect()], 50)
    out = dedup_substrings(odd, 50)
    assert out.columns == [*odd.columns, "n_words", "n_removed"]
    assert out.where("doc_id = 1").first()["text"] is None
    assert dedup_substrings(odd.limit(0)).count() == 0


def test_random_texts(documents):
    rng = random.Random(4)
    for size in (1, 2, 5, 8):
        rows = [(rng.randrange(25), " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for _ in range(40)]
        assert found(documents(rows), size) == brute(rows, size)


def test_levels(documents):
    assert levels_of(50, 7) == [7, 13, 25, 50] and levels_of(50, 25) == [25, 50] and levels_of(200, 25) == [25, 50, 100, 200] and levels_of(1, 25) == [1, 1]
    rng = random.Random(9)
    for size in (6, 7, 11):
        rows = [(rng.randrange(25), " ".join(rng.choice("aab") for _ in range(rng.randrange(40)))) for _ in range(30)]
        assert levels_of(size, 1)[0] == 1 and found(documents(rows), size, shortest=2) == brute(rows, size)


def test_white_space_between_kept_words_stays(documents):
    rows = [(1, "x a b c d"), (2, "p\n q\ta b  c\nd\n\nr  s ")]
    out = {r["doc_id"]: r["text"] for r in dedup_substrings(documents(rows), 4).collect()}
    assert out == {1: "x a b c d", 2: "p\n q\tr  s "}
    single = {r["doc_id"]: r["text"] for r in dedup_substrings(documents(rows), 4, keep_space=False).collect()}
    assert single[2] == "p q r s"


def test_ids_of_other_types_clashing_names_and_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(30_000))
    part = " ".join(long.split()[20_000:20_060])
    rows = [("k1", long, 5), ("k2", "x " + part + " y", 6), ("k0", "z " * 10, 7), (None, part, 8)]
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string, n_words long"), keep_space=False)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed"]
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in out.collect()} == {"k1": (30_000, 0, long), "k2": (62, 60, "x y"), "k0": (10, 0, "z " * 9 + "z"), None: (60, 0, part)}


def test_levels_end_where_nothing_survives(spark, documents, monkeypatch):
    from gneiss.llm import substrings

    seen, real = [], substrings.staged
    monkeypatch.setattr(substrings, "staged", lambda df, what: seen.append(what) or real(df, what))
    words = [" ".join(f"{a}{k}" for k in range(70)) for a in "abc"]
    assert dedup_substrings(documents(list(enumerate(words)))).where("n_removed > 0").count() == 0 and seen == ["level-7"]
    seen.clear()
    half = " ".join(f"a{k}" for k in range(10, 30))
    assert dedup_substrings(documents([*enumerate(words), (7, f"{words[2]} {half} {words[1][:0]}" + " ".join(f"q{k}" for k in range(60)))])).where("n_removed > 0").count() > 0
    assert seen == ["level-7", "level-13", "level-25", "level-stretches", "level-50"]


def test_blocks_are_sized_by_bytes(spark, documents, monkeypatch):
    from gneiss.llm import common

    monkeypatch.setattr(common, "BLOCK_BYTES", 300)
    monkeypatch.setattr(common, "TASK_BYTES", 900)
    rng = random.Random(12)
    rows = [(rng.randrange(60), " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for _ in range(150)]
    docs = documents(rows)
    blocks = common.Blocks(docs, "doc_id", "text")
    assert blocks.blocks > 10 and blocks.tasks > 4 and blocks.table.count() <= blocks.blocks
    assert blocks.table.groupBy("_block").count()._jdf.queryExecution().toString().count("Exchange") == 0
    assert found(docs, 6, shortest=2) == brute(rows, 6)


def test_whole_table(spark, sf):
    same(op2_substrings(spark, sf), connection(sf), OP2_SQL)
