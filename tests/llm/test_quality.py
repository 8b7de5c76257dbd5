from pyspark.sql import functions as F

from gneiss.llm.quality import OP5_SQL, op5_quality, quality_rules
from tests.oracle import connection, same


def test_odd_rows(odd):
    out = quality_rules(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == odd.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["n_words"] == 0 and rows[1]["base_failed"] and not rows[1]["kept"] and rows[2]["base_failed"]
    assert rows[10]["n_dup_lines"] == 1 and rows[10]["n_repeat_words"] == 110 and rows[10]["base_failed"]
    assert rows[7]["kept"] and rows[None]["kept"]
    assert quality_rules(odd.limit(0)).count() == 0


def table(spark, tmp_path):
    common = "this very line stands in most documents of its host and is no text of theirs"
    rows = [(k, common + f"\nsome words {k} of its own that are more than the common line has " + " ".join(f"w{k}x{j}" for j in range(12)), "a") for k in range(60)]
    rows += [(100 + k, common.upper() + f"\nfew own words {k}", "a") for k in range(30)]
    rows += [(200 + k, common + "\n" + " ".join(f"own{k}x{j}" for j in range(30)), "b") for k in range(5)]
    rows += [(300 + k, "an exact copy of a text with enough words in it to be kept\nand a second line", "a") for k in range(50)]
    rows += [(400, None, "a"), (401, "", None), (402, "x y z " * 10, None), (403, "no host but enough words here to be kept as it is", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_line_frequency(spark, tmp_path):
    import duckdb

    folder = table(spark, tmp_path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    out = op5_quality(spark, folder)
    same(out, c, OP5_SQL)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[k] for k in (*range(60), *range(200, 205), *range(300, 350), 403))
    assert not any(kept[k] for k in (*range(100, 130), 400, 401, 402))


def test_frequent_lines_are_cut_from_the_text(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(table(spark, tmp_path) + "/documents.parquet").withColumn("n_chars", F.length("text").cast("long"))
    was = {r["doc_id"]: r["text"] for r in docs.collect()}
    now = {r["doc_id"]: r["text"] for r in quality_rules(docs).collect()}
    assert now == {k: t.split("\n")[1] if k < 200 else t for k, t in was.items()}
    stage = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert stage == {k: (now[k], len(now[k])) for k in (*range(60), *range(200, 205), *range(300, 350), 403)}


def test_clashing_names_and_ids_of_another_type(spark):
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([("a", text, "h", 3, True, 7), ("b", "x", "h", 1, True, 7)], "doc_id string, text string, source string, n_words long, kept boolean, n_chars long")
    out = quality_rules(docs)
    assert len(set(out.columns)) == len(out.columns) and {(r["doc_id"], r["n_words"], r["kept"]) for r in out.collect()} == {("a", 20, True), ("b", 1, False)}
    stage = corpus_pipeline.quality(spark, docs, "")
    assert stage.columns == docs.columns and [(r["doc_id"], r["n_words"], r["n_chars"]) for r in stage.collect()] == [("a", 3, len(text))]


def test_one_scan_for_lines_and_one_for_rules(spark, tmp_path):
    docs = spark.read.parquet(table(spark, tmp_path) + "/documents.parquet")
    plan = quality_rules(docs)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("text:string") == 1 and "Python" not in plan and "InArrow" not in plan


def test_whole_table(spark, sf):
    same(op5_quality(spark, sf), connection(sf), OP5_SQL)


def test_enough_texts_on_a_large_host(spark):
    import corpus_pipeline

    line = "this line stands in few of the texts of a large host but in many texts"
    rows = [(k, (line + "\n" if k < 45 else "") + f"own{k} " * (5 if k < 45 else 12) + " ".join(f"w{k}x{j}" for j in range(5)), "a", 0) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert {r["doc_id"] for r in quality_rules(docs).where("n_removed_words > 0").collect()} == set()
    assert {r["doc_id"] for r in quality_rules(docs, enough_texts=45).where("n_removed_words > 0").collect()} == set()
    assert {r["doc_id"] for r in quality_rules(docs, enough_texts=44).where("n_removed_words > 0").collect()} == set(range(45))
    assert not any(line in r["text"] for r in corpus_pipeline.quality(spark, docs, "").collect())
