import pytest
from pyspark.sql import types as T

from gneiss.plans.catalog import Catalog, CatalogError
from gneiss.plans.ddl import TYPES, DdlError, parse_ddl, to_ddl
from gneiss.sources import rows

TABLE = "CREATE TABLE t (id INT UNSIGNED, title TEXT, marks ARRAY<TEXT>, v FLOAT[2]) WITH (ann_column_id='3', index_space='{}', segment_id_info='[id]')"
#: A column of every type, in the order of TYPES; then lists, options that are kept and one that isn't.
DDL = "CREATE TABLE every_type (" + ", ".join(f"c{k} {t}" for k, t in enumerate(TYPES)) + """,
  price DECIMAL(12, 3) NOT NULL, short VARCHAR(20) NULL, many ARRAY<DOUBLE>, pair SMALLINT[2], grid ARRAY<INT[3]>)
  WITH (note = 'it''s here', "quoted key" = 'x', number = 5, segment_id_info = '[c3, nowhere, price, c0]')"""


@pytest.fixture
def catalog(spark):
    return Catalog(spark)


@pytest.fixture
def filled(catalog):
    catalog.create(TABLE.format("L2Space"))
    catalog.insert("t", "0\x1ebasalt\x1edark\x1dheavy\x1e1\x1d2", "1\x1emarble\x1ewhite\x1e3\x1d4")
    return catalog


def test_ddl():
    spec = parse_ddl(DDL)
    n = len(TYPES)
    assert [f.dataType for f in spec.schema][:n] == list(TYPES.values()) and len(spec.schema) == n + 5
    assert [f.metadata["declared"] for f in spec.schema][:n] == list(TYPES)
    assert spec.segment_columns == ["c3", "price", "c0"] and spec.segment_indexes == [3, n, 0]
    assert spec.options == {"note": "it's here", "quoted key": "x", "segment_id_info": "[c3, nowhere, price, c0]"}
    assert spec.schema["pair"].metadata == {"declared": "SMALLINT[2]", "length": 2}
    assert spec.schema["grid"].dataType == T.ArrayType(T.ArrayType(T.IntegerType())) and spec.schema["grid"].metadata == {"declared": "ARRAY<INT[3]>", "item_length": 3}
    assert not spec.schema["price"].nullable and not spec.schema["c0"].nullable and spec.schema["short"].nullable
    assert to_ddl("x", spec.schema).startswith("CREATE TABLE x (c0 BOOLEAN, c1 TINYINT,")


@pytest.mark.parametrize("text", ["SELECT 1", "CREATE TABLE t (a JSON)", "CREATE TABLE t (a FLOAT[])", "CREATE TABLE t (a INT); CREATE TABLE u (a INT)", "CREATE TABLE t (a INT) WITH (ann_column_id='0')", "CREATE TABLE t (a INT, a INT)"])
def test_ddl_refused(text):
    with pytest.raises(DdlError):
        parse_ddl(text)


def test_tables(filled):
    with pytest.raises(CatalogError):
        filled.create(TABLE.format("L2Space"))
    assert [r["name"] for r in filled.list_tables().collect()] == ["t"]
    assert filled.describe("t").where("is_segment").first()["declared"] == "INT UNSIGNED"
    assert tuple(filled.indexed_count("t").first()) == (2, 2) and not filled.is_indexing("t")
    filled.drop("t")
    with pytest.raises(CatalogError):
        filled.scan("t")


def test_scan(filled):
    assert filled.scan("t", "*", "id\x1eisnotnull").count() == 2
    assert [tuple(r) for r in filled.scan("t", "title, id", "id\x1e1\x1e<").collect()] == [("basalt", 0)]
    assert filled.scan("t", "title", "id > 5").count() == 0
    assert filled.insert_json("t", '{"id": 6, "title": "slate", "marks": [], "v": [0, 1]}')["inserted_row_count"] == 1
    assert filled.debug_scan("t", "title", "id > 5").splitlines()[-1] == "| slate |"
    plan = filled.scan("t", "title", "id = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_segment_0" in plan


def test_row_text_is_checked(filled):
    for bad in ("2\x1eX", "2\x1eX\x1ea\x1e1\x1d2\x1d3", "-1\x1eX\x1ea\x1e1\x1d2", "x\x1eX\x1ea\x1e1\x1d2"):
        with pytest.raises(Exception, match="columns|items|range|x"):
            filled.insert("t", bad)
    assert filled.table("t").count() == 2


def test_batch_insert_is_checked_by_position(spark, filled):
    new = spark.createDataFrame([(2, "gneiss", ["banded"], [5.0, 6.0])], "a long, b string, c array<string>, d array<float>")
    assert filled.batch_insert("t", new)["inserted_row_count"] == 1
    assert filled.table("t").count() == 3
    for schema in ("a long, b string", "a string, b string, c array<string>, d array<float>"):
        with pytest.raises(rows.SchemaError):
            filled.batch_insert("t", spark.createDataFrame([], schema))
    with pytest.raises(Exception, match="null is not allowed"):
        filled.batch_insert("t", spark.createDataFrame([(None, "gneiss", ["banded"], [5.0, 6.0])], new.schema))


def test_segments_and_mixed_filters(spark, catalog):
    catalog.create("CREATE TABLE m (shard INT, price INT, label TEXT) WITH (segment_id_info='[shard]')")
    rows = [(k % 7, k * k % 31, f"lot {k}") for k in range(140)]
    catalog.batch_insert("m", spark.createDataFrame(rows[:90], "shard int, price int, label string"))
    catalog.batch_insert("m", spark.createDataFrame(rows[90:], "shard int, price int, label string"))
    assert catalog.segments("m", "shard\x1e3\x1e<\x1eprice\x1e10\x1e>\x1eand").count() == 3
    assert catalog.scan("m", "*", "shard < 3 AND price > 10 AND label LIKE '%5'").count() == sum(a < 3 and b > 10 and c.endswith("5") for a, b, c in rows)
    assert catalog.segments("m", "shard < 3 AND price > 10 OR label LIKE 'lot%'").count() == 7
    assert catalog.segments("m", "shard > 100 AND price = 3").count() == 0
    assert catalog.table("m")._jdf.queryExecution().toString().count("FileScan") == 1


def test_another_catalog_has_the_same_tables(spark, filled):
    other = Catalog(spark, filled.root)
    assert other.names() == ["t"] and other.table("t").count() == 2 and other.spec("t").segment_columns == ["id"]
    other.insert("t", "7\x1eslate\x1egrey\x1e0\x1d0")
    assert filled.table("t").count() == 3
    filled.drop("t")
    assert other.names() == [] and filled._list(filled.root) == []


def test_lists_in_lists_are_checked(spark, catalog):
    catalog.create("CREATE TABLE g (id INT, grid ARRAY<INT[2]>, v ARRAY<ARRAY<TEXT>>)")
    kind = "id int, grid array<array<int>>, v array<array<string>>"
    catalog.batch_insert("g", spark.createDataFrame([(1, [[1, 2], [3, 4]], [["a"], []])], kind))
    with pytest.raises(Exception, match="list in the list"):
        catalog.batch_insert("g", spark.createDataFrame([(1, [[1, 2], [3]], [])], kind))
    assert catalog.table("g").first()["grid"] == [[1, 2], [3, 4]]


def test_ann(filled):
    out = filled.ann("t", 2, [1.0, 1.0], projection="title, distance")
    assert [tuple(r) for r in out.collect()] == [("basalt", 1.0), ("marble", 13.0)]
    assert filled.ann("t", 5, "1,1", filter="title = 'marble'").count() == 1
    assert filled.ann("t", 5, "1,1", filter="title = 'marble'", filter_mode="segment").count() == 2
    assert filled.ann("t", 5, "1,1", filter="id = 7", filter_mode="segment").count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        filled.ann("t", 1, [1.0])
    batch = filled.batch_ann("t", 1, [[1.0, 1.0], [3.0, 3.0]], projection="title").orderBy("qid").collect()
    assert [(r["qid"], r["title"]) for r in batch] == [(0, "basalt"), (1, "marble")]
    filled.embedder = lambda text: [3.0, 4.0]
    assert filled.ann("t", 1, text="anything").first()["title"] == "marble"


def test_inner_product(spark, catalog):
    catalog.create(TABLE.format("IpSpace"))
    catalog.insert("t", "0\x1ea\x1ex\x1e1\x1d0", "1\x1eb\x1ex\x1e0\x1d2")
    assert [r["distance"] for r in catalog.ann("t", 2, [0.0, 1.0]).collect()] == [-1.0, 1.0]


def test_snapshot(spark, filled, tmp_path):
    filled.save(f"file://{tmp_path}/snap")
    other = Catalog(spark)
    other.load(f"file://{tmp_path}/snap")
    assert sorted(map(str, other.table("t").collect())) == sorted(map(str, filled.table("t").collect()))
    assert other.spec("t").options == filled.spec("t").options
    with pytest.raises(CatalogError):
        other.load(f"file://{tmp_path}")


def test_index_of_a_table_is_resumed(spark, catalog, tmp_path):
    catalog.create("CREATE TABLE p (id INT, v FLOAT[2]) WITH (ann_column_id='1')")
    catalog.batch_insert("p", spark.createDataFrame([(k, [float(k), 0.0]) for k in range(50)], "id int, v array<float>"))
    assert catalog.index("p") is None
    catalog.build_index("p", cells=4)
    catalog.save(f"file://{tmp_path}/snap")
    other = Catalog(spark)
    other.load(f"file://{tmp_path}/snap")
    for own in (catalog, other):
        index = own.index("p")
        assert (index.centres == catalog.index("p").centres).all() and [r["id"] for r in index.search([7.2, 0.0], 2, ef=8).collect()] == [7, 8]


def test_files(spark, catalog, tmp_path):
    catalog.create("CREATE TABLE f (id INT, seg TEXT, v FLOAT[2]) WITH (segment_id_info='[seg]')")
    df = spark.createDataFrame([(1, "A", [1.0, 2.0]), (2, "B", [3.0, 4.0])], "id int, seg string, v array<float>")
    df.write.parquet(f"{tmp_path}/p")
    df.write.json(f"{tmp_path}/j")
    (tmp_path / "c.csv").write_text('id,seg,v\n1,A,"(1.0, 2.0)"\n2,B,"[3, 4]"\n')
    for form, path in (("parquet", "p"), ("json", "j"), ("csv", "c.csv")):
        assert catalog.import_files("f", f"{tmp_path}/{path}", form)["inserted_row_count"] == 2
    assert catalog.table("f").distinct().count() == 2
    with pytest.raises(rows.SchemaError):
        catalog.import_files("f", f"{tmp_path}/p", "orc")
    assert catalog.ddl_of_parquet("f", f"{tmp_path}/p") == "CREATE TABLE f (id INT, seg TEXT, v ARRAY<FLOAT>) WITH ( ... write metadata ... );"


def test_results(spark, filled):
    df = filled.scan("t", "id, title").orderBy("id")
    assert '"data": [{"id": 0, "title": "basalt"}' in rows.to_json(df)
    assert rows.from_ipc(spark, rows.to_ipc(df)).count() == 2
    assert rows.to_markdown(df).splitlines()[0] == "| id | title |"
    assert '"data_list": [[{"rank": 1' in rows.batch_to_json(filled.batch_ann("t", 1, [[1.0, 1.0]]))


def test_segment_runs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, s) for k, s in enumerate("AAABBCCCAB")], "k int, s string")
    for size in (1, 3, 100):
        out = rows.segment_runs(df, ["s"], ["k"], F.floor(F.col("k") / size)).orderBy("k").collect()
        assert [r["run"] for r in out] == [0, 0, 0, 1, 1, 2, 2, 2, 3, 4]


def test_merge(spark):
    from gneiss.operators import vectors

    parts = [spark.createDataFrame([(i * 40 + k, float((k * 7 + i) % 97)) for k in range(40)], "id int, distance double") for i in range(6)]
    out = [r["distance"] for r in vectors.merge_top_k(parts, 140, "id").collect()]
    assert out == sorted(float((k * 7 + i) % 97) for i in range(6) for k in range(40))[:140]
    with pytest.raises(ValueError):
        vectors.merge_top_k([], 1)
    with pytest.raises(ValueError):
        vectors.union_all([parts[0], parts[1].select("distance", "id")])


def test_recall_of_cells(spark):
    import numpy as np

    from gneiss.operators import vectors

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 10)).astype("float32")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    index, shares = vectors.CellIndex(df, cells=16), []
    assert index.rows.count() == 3000
    for q in x[:3].tolist():
        exact = [r["distance"] for r in vectors.ann(df, q, 10).collect()]
        shares.append(vectors.recall([r["distance"] for r in index.search(q, 10, ef=100).collect()], exact))
    assert sum(shares) / 3 >= 0.9


def test_recall_of_cells_at_own_settings(spark):
    import numpy as np

    from gneiss.operators import vectors

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype("float32")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    queries = [(k, x[k].tolist()) for k in range(0, 3000, 50)]
    for metric in ("l2", "ip"):
        index = vectors.CellIndex(df, metric=metric)
        true = {(r["qid"], r["vec_id"]) for r in vectors.batch_ann(df, queries, 10, metric=metric).collect()}
        rows = index.batch_search(queries, 10).collect()
        got = {(r["qid"], r["vec_id"]) for r in rows}
        assert len(got) == len(true) == 600 and len(got & true) >= 0.9 * 600
        own = [r["vec_id"] for r in index.search(queries[7][1], 10).collect()]
        assert own == [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["qid"] == queries[7][0]]


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_batch_ann_of_all_ids_divisible_by_50(spark, sf, monkeypatch, metric):
    from gneiss import queries
    from gneiss.operators import vectors
    from tests.oracle import connection, same

    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(vectors, "ROWS_AT_ONCE", 70)
    rows = queries.Tables(spark, sf).embeddings
    table = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid")
    asked = [(r["qid"], list(r["embedding"])) for r in table.collect()]
    assert len(asked) > 2 * vectors.QUERIES_AT_ONCE
    sql = queries.batch_sql(queries.L2 if metric == "l2" else queries.IP)
    parts = [vectors.batch_ann(rows.where(f"vec_id % 3 = {k}"), asked, 5, metric=metric).drop("rank") for k in range(3)]
    for out in (vectors.batch_ann(rows, asked, 5, metric=metric), vectors.batch_ann(rows, table, 5, metric=metric), vectors.merge_batch_top_k(parts, 5, "vec_id")):
        same(queries.rounded(out, "qid", "rank", "vec_id"), connection(sf), sql)


def test_index_of_no_rows_and_added_ones(spark, tmp_path):
    from gneiss.operators import vectors

    kind = "vec_id long, embedding array<float>"
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(40)] + [(99, None), (98, [1.0])], kind)
    empty = vectors.CellIndex(spark.createDataFrame([], kind))
    assert empty.search([0.0, 1.0], 3).count() == 0 and empty.batch_search([(1, [0.0, 1.0])], 3).count() == 0
    for index in (empty, vectors.CellIndex(spark.createDataFrame([], kind)).write(f"file://{tmp_path}/index")):
        assert [r["vec_id"] for r in index.add(rows).search([7.2, 1.0], 2, ef=200).collect()] == [7, 8]
    again = vectors.CellIndex.open(spark, f"file://{tmp_path}/index").add(spark.createDataFrame([(50, [7.1, 1.0])], kind))
    assert [r["vec_id"] for r in again.search([7.2, 1.0], 2, ef=200).collect()] == [50, 7]


def test_a_part_of_the_cells_suffices_where_rows_cluster(spark):
    import numpy as np

    from gneiss.operators import vectors

    rng = np.random.default_rng(4)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] * 4 + rng.normal(size=(4000, 16))).astype("float32")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    queries = [(k, x[k].tolist()) for k in range(0, 4000, 50)]
    for metric in ("l2", "ip"):
        index = vectors.CellIndex(df, cells=64, metric=metric)
        true = {(r["qid"], r["vec_id"]) for r in vectors.batch_ann(df, queries, 10, metric=metric).collect()}
        got = {(r["qid"], r["vec_id"]) for r in index.batch_search(queries, 10).collect()}
        assert len(got & true) >= 0.9 * len(true)
        if metric == "l2":
            sizes = {r["cell"]: r["count"] for r in index.rows.groupBy("cell").count().collect()}
            read = sum(sizes.get(c, 0) for _, q in queries for c in index.probes(q, index.enough(10)))
            assert index.enough(10) <= 16 and read <= 0.3 * len(queries) * 4000
