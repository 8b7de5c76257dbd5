import numpy as np

from gneiss.llm.embeddings import OP9_SQL, near_embeddings, op9_embeddings
from tests.llm.test_common import roots
from tests.oracle import connection, same


def brute(rows, threshold):
    ok = [(i, l, np.array(v, float)) for i, v, l in rows if i is not None and l is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    links = [(a[0], b[0]) for n, a in enumerate(ok) for b in ok[:n] if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= threshold]
    root, n = roots(links), {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    return sorted(((str(i), n.get(i, 0), root.get(i, i), None if i is None else root.get(i, i) == i) for i, _, _ in rows), key=str)


def found(spark, rows, threshold, **kw):
    df = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], "vec_id long, embedding array<float>, label int, rep string")
    return sorted(((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in near_embeddings(df, threshold, **kw).collect()), key=str)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [1.0], 1), (11, [3.0], 1), (12, [1.0, -0.0], 1), (13, [1.0, 0.05], 1), (14, [], 1), (None, [1.0, 0.0], 1)]
    assert found(spark, rows, 0.93) == brute(rows, 0.93)
    assert found(spark, [], 0.93) == []


def test_random_vectors_with_copies_and_a_hot_label(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(300):
        v = (centres[k % 6] + rng.normal(size=8) * (0.25 if k % 3 else 0.0)).astype("float32").tolist()
        rows.append((1000 - k, v, 1 if k % 4 else 2))
    for tile in (7, 64, 2048):
        assert found(spark, rows, 0.93, tile=tile) == brute([(i, np.array(v, "float32").tolist(), l) for i, v, l in rows], 0.93)


def test_repeated_rows_and_ids_of_another_type(spark):
    rows = [("b", [1.0, 0.0], 1), ("b", [1.0, 0.0], 1), ("a", [2.0, 0.1], 1), ("c", [0.0, 1.0], 1), ("c", [1.0, 0.0], 1), ("d", [1e-200, 0.0], 1), ("e", [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")
    out = sorted(tuple(r) for r in near_embeddings(df).collect())
    assert out == [("a", 3, "a", True), ("b", 3, "a", False), ("b", 3, "a", False), ("c", 1, "c", True), ("c", 3, "a", False), ("d", 3, "a", False), ("e", 1, "c", False)]


def test_pairs_around_the_threshold(spark):
    """Vectors of one plane a fraction of a degree apart: most cosines are within what int8 leaves open."""
    rng, turn = np.random.default_rng(5), np.arccos(0.93)
    rows = []
    for k in range(240):
        angle = turn * (k % 3) + rng.normal() * 1e-4
        v = np.zeros(16)
        v[k % 2 * 5], v[k % 2 * 5 + 1] = np.cos(angle), np.sin(angle)
        rows.append((k, (v * rng.uniform(0.1, 9)).astype("float32").tolist(), 1))
    for tile in (50, 2048):
        out = found(spark, rows, 0.93, tile=tile)
        assert out == brute([(i, np.array(v, "float32").tolist(), l) for i, v, l in rows], 0.93)
    assert len({r[1] for r in out}) > 20


def test_table_with_links(spark, tables):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 12))
    rows = [(k, (centres[k % 5] + rng.normal(size=12) * 0.3).astype("float32").tolist(), k % 3 or None) for k in range(150)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(40)]
    folder, c = tables("embeddings", rows, "vec_id long, embedding array<float>, label int")
    out = op9_embeddings(spark, folder)
    same(out, c, OP9_SQL)
    assert out.where("n_links > 3").count() > 50 and out.where("NOT kept").count() > 50


def test_whole_table(spark, sf):
    same(op9_embeddings(spark, sf), connection(sf), OP9_SQL)
