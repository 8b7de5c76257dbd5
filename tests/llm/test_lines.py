import random

import pytest
import xxhash

from gneiss.llm.lines import OP4_SQL, dedup_lines, op4_lines, variant_texts, within
from tests.oracle import connection, same


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(rows, least, bound=1):
    lines = sorted((i, k, x.strip(" \t\n\r\v\f")) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n")))
    lines = [x for x in lines if len(x[2]) >= least]
    gone = {(b[0], b[1]) for n, b in enumerate(lines) if any(a[:2] < b[:2] and distance(a[2], b[2]) <= bound for a in lines[:n])}
    return sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows)


@pytest.mark.parametrize("bound", [0, 1, 2])
def test_random_lines(documents, bound):
    rng = random.Random(6)
    for alphabet in ("ab", "abcé"):
        rows = []
        for i in range(30):
            rows.append((i, "\n".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 6)))))
        out = dedup_lines(documents(rows), 3, bound=bound)
        assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == brute(rows, 3, bound)


def test_odd_rows(odd):
    out = dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed_lines"]
    rows = {(r["doc_id"], r["n_removed_lines"]) for r in out.collect()}
    assert {(5, 0), (6, 1), (7, 0), (None, 0), (-4, 0), (10, 2), (1, 0), (2, 0)} <= rows
    assert out.count() == odd.count() and dedup_lines(odd.limit(0)).count() == 0


def test_within():
    rng = random.Random(7)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(2))
        for bound in (0, 1, 2, 3):
            assert within(a, b, bound) == (distance(a, b) <= bound)
            assert bool(variant_texts(a, bound) & variant_texts(b, bound)) == (distance(a, b) <= bound)


def test_ids_of_other_types_and_clashing_names(spark):
    rows = [("b", "one line that is long enough", 1), ("a", "one line that is long enough", 2), (None, "one line that is long enough", 3)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id string, text string, n_lines long"))
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed_lines"]
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"]) for r in out.collect()) == [("None", rows[0][1], 1), ("a", rows[0][1], 1), ("b", "", 1)]


def test_whole_table(spark, sf):
    same(op4_lines(spark, sf), connection(sf), OP4_SQL)


def test_shorter_line_between_two_longer_ones_of_a_block(spark, documents):
    """The whole line is in another block, after one and before another line that has a character more."""
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def block(i):
        x = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
        return (x - (1 << 64) if x >> 63 else x) % blocks

    first = 1
    last = next(i for i in range(3, 10000) if block(i) == block(first))
    between = next(i for i in range(2, last) if block(i) != block(first))
    line = "a line that stands whole in one document"
    rows = sorted([(first, "X" + line), (between, line), (last, line + "Y")])
    out = sorted((r["doc_id"], r["text"]) for r in dedup_lines(documents(rows)).collect())
    assert out == brute(rows, 20) == [(first, "X" + line), (between, ""), (last, "")]


def test_short_lines_go_if_equal(spark, documents):
    import corpus_pipeline

    rng, rows = random.Random(10), []
    for i in range(30):
        rows.append((i, "\n".join(rng.choice(("", " ")) + "".join(rng.choice("ab") for _ in range(rng.randrange(8))) for _ in range(rng.randrange(1, 6)))))
    seen, want = [], []
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            s = x.strip()
            if not s or not any(s == y or len(s) >= 5 and len(y) >= 5 and distance(s, y) <= 1 for y in seen):
                kept.append(x)
            seen.append(s)
        want.append((i, "\n".join(kept)))
    out = dedup_lines(documents(rows), 5, min_exact=1)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == want
    docs = documents([(1, "short\n\nyes"), (2, "\nshort\nshirt"), (3, " yes\n")])
    out = corpus_pipeline.lines(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "short\n\nyes"), (2, "\nshirt"), (3, "")]
