"""The registered queries, each beside SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.common import new_path
from gneiss.functions import geo, keys, lists, strings
from gneiss.functions.registry import Functions, Scripts, evaluate
from gneiss.operators import counters, ranked, sets, sorting, vectors
from gneiss.plans.filters import RS, parse_filter, select_list, to_column
from gneiss.sources.rows import batch_to_json, from_ipc, from_text, segment_id, segment_runs, to_ipc, to_json, to_markdown
from gneiss.streaming import logs
from gneiss.streaming.groups import sessions, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, f: Callable[[Tables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def scan(df: DataFrame, projection: str, filter: str | None = None) -> DataFrame:
    e = parse_filter(filter, df.columns)
    out = df if e is None else df.where(to_column(e, df.schema))
    return out.select(*select_list(projection, df.columns))


def wire(*tokens: object) -> str:
    return RS.join(map(str, tokens))


# Scans and filters

query("scan_all", "SELECT * FROM nation", lambda t: scan(t.nation, "*"))
query("scan_projection", "SELECT o_orderkey, o_totalprice FROM orders", lambda t: scan(t.orders, "o_orderkey, o_totalprice"))
query("scan_projection_order", "SELECT o_orderpriority, o_orderkey, o_custkey FROM orders", lambda t: scan(t.orders, "o_orderpriority, o_orderkey,o_custkey"))
for _name, _op in (("eq", "="), ("neq", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    query(f"filter_{_name}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25", lambda t, op=_op: scan(t.lineitem, "l_orderkey, l_linenumber, l_quantity", wire("l_quantity", "25", op)))
    query(f"filter_infix_{_name}", f"SELECT o_orderkey FROM orders WHERE o_orderstatus {_op} 'O'", lambda t, op=_op: scan(t.orders, "o_orderkey", f"o_orderstatus {op} 'O'"))
query("filter_and_or_precedence", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000 AND o_orderpriority = '1-URGENT'", lambda t: scan(t.orders, "o_orderkey", "o_orderstatus = 'F' OR o_totalprice > 200000 AND o_orderpriority = '1-URGENT'"))
query("filter_and_or_wire", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_custkey < 500", lambda t: scan(t.orders, "o_orderkey", wire("o_orderstatus", "F", "eq", "o_totalprice", "200000", "gt", "or", "o_custkey", "500", "lt", "and")))
query("filter_not_demorgan", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey < 500)", lambda t: scan(t.orders, "o_orderkey", wire("o_orderstatus", "F", "=", "o_custkey", "500", "<", "and", "not")))
query("filter_nested_paren", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 10 OR (l_discount > 0.05 AND NOT (l_tax = 0.02))) AND l_returnflag = 'R'", lambda t: scan(t.lineitem, "l_orderkey, l_linenumber", "(l_quantity < 10 OR (l_discount > 0.05 AND NOT (l_tax = 0.02))) AND l_returnflag = 'R'"))
query("filter_isnull", "SELECT event_id FROM events WHERE nullif(event_type, 'click') IS NULL", lambda t: scan(t.events.withColumn("kind", F.nullif("event_type", F.lit("click"))), "event_id", wire("kind", "isnull")))
query("filter_isnotnull", "SELECT event_id FROM events WHERE nullif(event_type, 'click') IS NOT NULL", lambda t: scan(t.events.withColumn("kind", F.nullif("event_type", F.lit("click"))), "event_id", "kind IS NOT NULL"))
query("filter_null_comparison", "SELECT event_id FROM events WHERE NOT (nullif(event_type, 'click') = 'view')", lambda t: scan(t.events.withColumn("kind", F.nullif("event_type", F.lit("click"))), "event_id", "NOT kind = 'view'"))
query("filter_in", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)", lambda t: scan(t.part, "p_partkey", "p_size IN (1, 5, 9)"))
query("filter_in_wire", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')", lambda t: scan(t.orders, "o_orderkey", wire("o_orderstatus", '"F" "P"', "in")))
query("filter_not_in_keeps_null", "SELECT event_id FROM events WHERE coalesce(nullif(event_type, 'click') NOT IN ('view', 'error'), true)", lambda t: scan(t.events.withColumn("kind", F.nullif("event_type", F.lit("click"))), "event_id", "kind NOT IN ('view', 'error')"))
query("like_prefix", "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#00000000%'", lambda t: scan(t.customer, "c_custkey", wire("c_name", "Customer#00000000%", "like")))
query("like_suffix", "SELECT c_custkey FROM customer WHERE c_name LIKE '%7'", lambda t: scan(t.customer, "c_custkey", wire("c_name", "%7", "like")))
query("like_contains", "SELECT p_partkey FROM part WHERE p_name LIKE '%re%'", lambda t: scan(t.part, "p_partkey", wire("p_name", "%re%", "like")))
query("like_full", "SELECT p_partkey FROM part WHERE p_name LIKE '%e_ %'", lambda t: scan(t.part, "p_partkey", "p_name LIKE '%e_ %'"))
query("not_like_prefix", "SELECT p_partkey FROM part WHERE NOT p_name LIKE 'g%'", lambda t: scan(t.part, "p_partkey", wire("p_name", "g%", "like", "not")))
query("not_like_contains", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%re%'", lambda t: scan(t.part, "p_partkey", "p_name NOT LIKE '%re%'"))
query("literal_left_operand", "SELECT o_orderkey FROM orders WHERE 500 > o_custkey", lambda t: scan(t.orders, "o_orderkey", wire("500", "o_custkey", ">")))
query("filter_timestamp", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'", lambda t: scan(t.orders, "o_orderkey", "o_orderdate >= '1996-01-01'"))

# Segments and rows of text

query("segment_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", lambda t: in_segments(t.orders, ["o_orderstatus"], "o_orderkey, o_orderstatus", "o_orderstatus = 'F'"))
query("segment_prune_multi", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' AND o_totalprice > 100000", lambda t: in_segments(t.orders, ["o_orderstatus", "o_orderpriority"], "o_orderkey", "o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' AND o_totalprice > 100000"))
query("segment_ids", "SELECT concat_ws(chr(30), o_orderstatus, o_orderpriority) AS segment_id, count(*)::BIGINT AS n FROM orders GROUP BY ALL", lambda t: t.orders.groupBy(segment_id(["o_orderstatus", "o_orderpriority"]).alias("segment_id")).agg(F.count("*").alias("n")))
query("segment_runs", "SELECT l_orderkey, l_linenumber, sum(c) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(l_returnflag) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) IS DISTINCT FROM l_returnflag AND row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) > 1 THEN 1 ELSE 0 END AS c FROM lineitem)", lambda t: segment_runs(t.lineitem, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "run"))
query("row_text", "SELECT n_nationkey::BIGINT AS id, n_name AS name, [n_name, 'x'] AS tags FROM nation", lambda t: rows_of_text(t))
query("indexed_count", "SELECT count(*)::BIGINT AS total, count(embedding)::BIGINT AS indexed FROM embeddings", lambda t: vector_table(t).indexed_count("vectors"))
query("indexed_count_of_nodes", "SELECT count(*)::BIGINT AS total, count(embedding)::BIGINT AS indexed FROM embeddings", lambda t: vector_nodes(t).indexed_counts(["n0", "n1", "n2"]))
query("node_union_all", "SELECT vec_id, label FROM embeddings", lambda t: vectors.union_all([t.embeddings.where(F.col("vec_id") % 3 == k).select("vec_id", "label") for k in range(3)]))


def in_segments(df: DataFrame, columns: list[str], projection: str, filter: str) -> DataFrame:
    from gneiss.plans.catalog import Catalog
    from gneiss.plans.ddl import TableSpec

    catalog = Catalog(df.sparkSession)
    catalog.create(TableSpec("rows", df.schema, {"segment_id_info": f"[{', '.join(columns)}]"}))
    catalog.batch_insert("rows", df)
    return catalog.scan("rows", projection, filter)


def rows_of_text(t: Tables) -> DataFrame:
    from gneiss.plans.ddl import parse_ddl

    spec = parse_ddl("CREATE TABLE nations (id INT UNSIGNED, name TEXT, tags ARRAY<TEXT>)")
    return from_text(spec, t.nation.select(F.concat_ws(RS, F.col("n_nationkey").cast("string"), "n_name", F.concat("n_name", F.lit("\x1dx"))).alias("value")))


# Vector search

L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
IP = "1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def nearest_sql(d: str, where: str = "", k: int = 10, queries: str = "vec_id = 0") -> str:
    return f"SELECT vec_id, label, round(d, 5) + 0.0 AS distance FROM (SELECT e.vec_id, e.label, round({d}, 12) + 0.0 AS d FROM embeddings e, (SELECT * FROM embeddings WHERE {queries}) q {where}) ORDER BY d, vec_id LIMIT {k}"


def batch_sql(d: str, k: int = 5) -> str:
    return f"SELECT qid, rank, vec_id, round(d, 5) + 0.0 AS distance FROM (SELECT q.vec_id AS qid, e.vec_id, {d} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({d}, 12), e.vec_id)::INTEGER AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= {k}"


def one(t: Tables, vec_id: int = 0) -> list[float]:
    return list(t.embeddings.where(F.col("vec_id") == vec_id).first()["embedding"])


def asking(t: Tables) -> DataFrame:
    """The queries of a batch: every row whose id is divisible by 50."""
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, (F.round("distance", 5) + 0.0).alias("distance"))


query("ann_l2", nearest_sql(L2), lambda t: rounded(vectors.ann(t.embeddings, one(t), 10), "vec_id", "label"))
query("ann_ip", nearest_sql(IP), lambda t: rounded(vectors.ann(t.embeddings, one(t), 10, metric="ip"), "vec_id", "label"))
query("ann_expression_l2", nearest_sql(L2), lambda t: rounded(t.embeddings.withColumn("distance", vectors.distance("embedding", one(t))).orderBy("distance", "vec_id").limit(10), "vec_id", "label"))
query("ann_filtered_rows", nearest_sql(L2, "WHERE e.label < 3 AND e.vec_id > 50"), lambda t: rounded(vectors.ann(scan(t.embeddings, "*", "label < 3 AND vec_id > 50"), one(t), 10), "vec_id", "label"))
query("ann_filtered_segment", nearest_sql(L2, "WHERE e.label = 1"), lambda t: rounded(table_ann(t, "label = 1 AND vec_id > 50", "segment"), "vec_id", "label"))
query("ann_catalog_rows", nearest_sql(L2, "WHERE e.label = 1 AND e.vec_id > 50"), lambda t: rounded(table_ann(t, "label = 1 AND vec_id > 50", "rows"), "vec_id", "label"))
query("batch_ann_l2", batch_sql(L2), lambda t: rounded(vectors.batch_ann(t.embeddings, asking(t), 5), "qid", "rank", "vec_id"))
query("batch_ann_ip", batch_sql(IP), lambda t: rounded(vectors.batch_ann(t.embeddings, asking(t), 5, metric="ip"), "qid", "rank", "vec_id"))
query("ann_multi_node_merge", nearest_sql(L2), lambda t: rounded(vectors.merge_top_k([vectors.ann(t.embeddings.where(F.col("vec_id") % 3 == k), one(t), 10) for k in range(3)], 10, "vec_id"), "vec_id", "label"))
query("batch_ann_multi_node_merge", batch_sql(L2), lambda t: rounded(vectors.merge_batch_top_k([vectors.batch_ann(t.embeddings.where(F.col("vec_id") % 3 == k), asking(t), 5).drop("rank") for k in range(3)], 5, "vec_id"), "qid", "rank", "vec_id"))
query("ann_index_resumed_l2", nearest_sql(L2), lambda t: resumed(t, "l2"))
query("ann_index_resumed_ip", nearest_sql(IP), lambda t: resumed(t, "ip"))
query("ann_by_text", nearest_sql(L2), lambda t: by_text(t))
query("ann_cell_index_recall", "SELECT true AS enough", lambda t: cell_recall(t))


def vector_table(t: Tables, metric: str = "L2Space", name: str = "vectors", rows: DataFrame | None = None, catalog=None):
    """A catalog with the embeddings, or some of them, as a table."""
    from gneiss.plans.catalog import Catalog

    catalog = catalog or Catalog(t.spark)
    catalog.create(f"CREATE TABLE {name} (vec_id BIGINT, embedding FLOAT[{len(one(t))}], label INT) WITH (ann_column_id='1', index_space='{metric}', segment_id_info='[label]')")
    catalog.batch_insert(name, t.embeddings if rows is None else rows)
    return catalog


def vector_nodes(t: Tables):
    """The embeddings as three tables, as three nodes have them."""
    catalog = None
    for k in range(3):
        catalog = vector_table(t, "L2Space", f"n{k}", t.embeddings.where(F.col("vec_id") % 3 == k), catalog)
    return catalog


def table_ann(t: Tables, filter: str, mode: str) -> DataFrame:
    return vector_table(t).ann("vectors", 10, one(t), filter=filter, filter_mode=mode)


def resumed(t: Tables, metric: str) -> DataFrame:
    """What an index that was written in two parts and opened again finds if it probes all cells: the exact answer."""
    path = folder(t)
    vectors.CellIndex(t.embeddings.where("vec_id % 3 > 0"), metric=metric, cells=8).write(path).add(t.embeddings.where("vec_id % 3 = 0"))
    index = vectors.CellIndex.open(t.spark, path)
    return rounded(index.search(one(t), 10, ef=80).select(*t.embeddings.columns, "distance"), "vec_id", "label")


def by_text(t: Tables) -> DataFrame:
    """A search for a text, with an embedder that knows one."""
    catalog, v = vector_table(t), one(t)
    catalog.embedder = {"first": v}.__getitem__
    return rounded(catalog.ann("vectors", 10, text="first"), "vec_id", "label")


def cell_recall(t: Tables) -> DataFrame:
    """Whether a search of the probed cells alone finds nine in ten of the true neighbours, at the index's own settings,
    over the rows whose id is divisible by 50."""
    share = cell_shares(t).agg(F.avg("share")).first()[0]
    return t.spark.createDataFrame([(share >= 0.9,)], "enough boolean")


def cell_shares(t: Tables, k: int = 10) -> DataFrame:
    """(qid, share): of each query's k nearest rows, the share that the index finds."""
    index, rows = vectors.CellIndex(t.embeddings), t.embeddings.where("vec_id % 50 = 0").select("vec_id", "embedding")
    queries = [(r["vec_id"], list(r["embedding"])) for r in rows.collect()]
    exact = vectors.batch_ann(t.embeddings, queries, k).groupBy("qid").agg(F.max("distance").alias("furthest"), F.count("*").alias("n"))
    found = index.batch_search(queries, k).join(exact, "qid").where("distance <= furthest + 1e-9").groupBy("qid").agg(F.count("*").alias("found"))
    return exact.join(found, "qid", "left").select("qid", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("share"))


# Sets


def customers(t: Tables, status: str) -> DataFrame:
    return sets.members(t.orders.where(F.col("o_orderstatus") == status), "o_custkey")


SET = "SELECT o_custkey AS member FROM orders WHERE o_orderstatus = '{}'"
F_, O_, P_ = (SET.format(x) for x in "FOP")
query("set_members", f"SELECT DISTINCT * FROM ({F_})", lambda t: customers(t, "F"))
query("set_union", f"{F_} UNION {O_} UNION {P_}", lambda t: sets.union(*(customers(t, x) for x in "FOP")))
query("set_inter", f"{F_} INTERSECT {O_} INTERSECT {P_}", lambda t: sets.inter(*(customers(t, x) for x in "FOP")))
query("set_intercard", f"SELECT count(*)::BIGINT AS n FROM ({F_} INTERSECT {P_})", lambda t: sets.inter_card(customers(t, "F"), customers(t, "P")))
query("set_intercard_limit", f"SELECT least(count(*), 7)::BIGINT AS n FROM ({F_} INTERSECT {P_})", lambda t: sets.inter_card(customers(t, "F"), customers(t, "P"), limit=7))
query("set_diff", f"{F_} EXCEPT {P_}", lambda t: sets.diff(customers(t, "F"), customers(t, "P")))
query("set_card", f"SELECT count(DISTINCT member)::BIGINT AS n FROM ({F_})", lambda t: sets.card(customers(t, "F")))
query("set_ismember", f"SELECT c_custkey AS member, (c_custkey IN ({P_}))::INTEGER AS is_member FROM customer", lambda t: sets.is_member(customers(t, "P"), t.customer.select(F.col("c_custkey").alias("member"))))
query("set_add_remove", f"({F_} UNION {P_}) EXCEPT SELECT c_custkey FROM customer WHERE c_custkey < 100", lambda t: sets.remove(sets.add(customers(t, "F"), customers(t, "P")), t.customer.where("c_custkey < 100").select(F.col("c_custkey").alias("member"))))
query("set_move", f"SELECT member FROM ({P_}) UNION SELECT member FROM ({F_}) WHERE member < 200", lambda t: sets.move(customers(t, "F"), customers(t, "P"), t.customer.where("c_custkey < 200").select(F.col("c_custkey").alias("member")))[1])
query("set_scan_match", "SELECT DISTINCT p_name AS member FROM part WHERE regexp_matches(p_name, '^[a-g].*e$')", lambda t: sets.members(t.part, "p_name").where(sets.matches("member", "[a-g]*e")))
query("set_random_members", f"SELECT 10::BIGINT AS n, 10::BIGINT AS different, 10::BIGINT AS members FROM ({F_}) HAVING count(DISTINCT member) > 10", lambda t: drawn_members(t, 10))
query("set_random_repeats", f"SELECT (2 * count(DISTINCT member))::BIGINT AS n, (2 * count(DISTINCT member))::BIGINT AS members FROM ({F_})", lambda t: drawn_members(t, -2 * customers(t, "F").count()).drop("different"))


def drawn_members(t: Tables, n: int) -> DataFrame:
    """(rows, different members, rows that are members) of a sample."""
    return sets.random_members(customers(t, "F"), n).join(customers(t, "F").withColumn("is", F.lit(1)), "member", "left").agg(F.count("*").alias("n"), F.count_distinct("member").alias("different"), F.count("is").alias("members"))


query("set_pop_left", f"SELECT count(DISTINCT member)::BIGINT - 5 AS n FROM ({F_})", lambda t: sets.card(sets.pop(customers(t, "F"), 5)[1]))

# Ranked sets


def totals(t: Tables, status: str) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("member")).agg(F.max("o_totalprice").alias("score"))


ZSET = "(SELECT o_custkey AS member, max(o_totalprice) AS score FROM orders WHERE o_orderstatus = '{}' GROUP BY 1)"
ZF, ZO, ZP = (ZSET.format(x) for x in "FOP")
WEIGHTED = f"(SELECT member, 2 * score AS score, 0 AS k FROM {ZF} UNION ALL SELECT member, 0.5 * score, 1 FROM {ZO} UNION ALL SELECT member, 3 * score, 2 FROM {ZP})"
for _agg in ("sum", "min", "max"):
    query(f"zunion_{_agg}", f"SELECT member, round({_agg}(score), 4) AS score FROM {WEIGHTED} GROUP BY member", lambda t, a=_agg: ranked.union([totals(t, x) for x in "FOP"], [2, 0.5, 3], a).select("member", F.round("score", 4).alias("score")))
    query(f"zinter_{_agg}", f"SELECT member, round({_agg}(score), 4) AS score FROM {WEIGHTED} GROUP BY member HAVING count(*) = 3", lambda t, a=_agg: ranked.inter([totals(t, x) for x in "FOP"], [2, 0.5, 3], a).select("member", F.round("score", 4).alias("score")))
query("zintercard", f"SELECT count(*)::BIGINT AS n FROM (SELECT member FROM {ZF} INTERSECT SELECT member FROM {ZP})", lambda t: ranked.inter_card([totals(t, "F"), totals(t, "P")]))
query("zdiff", f"SELECT member, score FROM {ZF} WHERE member NOT IN (SELECT member FROM {ZP})", lambda t: ranked.diff(totals(t, "F"), totals(t, "P")))


def parts(t: Tables) -> DataFrame:
    return t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("member"), F.col("p_retailprice").alias("score"))


PARTS = "(SELECT 'p' || p_partkey AS member, p_retailprice AS score FROM part)"
RANKED = f"(SELECT member, score, row_number() OVER (ORDER BY score, member) - 1 AS rank, row_number() OVER (ORDER BY score DESC, member DESC) - 1 AS back FROM {PARTS})"
query("zrange_rank", f"SELECT member, score, rank::BIGINT AS rank FROM {RANKED} WHERE rank BETWEEN 5 AND 20", lambda t: ranked.by_rank(parts(t), 5, 20))
query("zrange_rank_from_end", f"SELECT member, score, rank::BIGINT AS rank FROM {RANKED} WHERE back <= 9", lambda t: ranked.by_rank(parts(t), -10, -1))
query("zrevrange", f"SELECT member, score, back::BIGINT AS rank FROM {RANKED} WHERE back BETWEEN 3 AND 9", lambda t: ranked.by_rank(parts(t), 3, 9, reverse=True))
query("zrange_score", f"SELECT member, score FROM {PARTS} WHERE score > 920 AND score <= 960 ORDER BY score, member LIMIT 25 OFFSET 10", lambda t: ranked.by_score(parts(t), "(920", 960, offset=10, count=25))
query("zrevrange_score", f"SELECT member, score FROM {PARTS} WHERE score >= 980 ORDER BY score DESC, member DESC LIMIT 12", lambda t: ranked.by_score(parts(t), 980, "inf", reverse=True, count=12))
query("zrange_lex", f"SELECT member, score FROM {PARTS} WHERE member >= 'p1' AND member < 'p11' ORDER BY member LIMIT 40", lambda t: ranked.by_lex(parts(t), "[p1", "(p11", count=40))
query("zrevrange_lex", f"SELECT member, score FROM {PARTS} WHERE member > 'p5' ORDER BY member DESC LIMIT 15", lambda t: ranked.by_lex(parts(t), "(p5", "+", reverse=True, count=15))
query("zcount", f"SELECT count(*)::BIGINT AS n FROM {PARTS} WHERE score >= 950 AND score < 980", lambda t: ranked.count(parts(t), 950, "(980"))
query("zlexcount", f"SELECT count(*)::BIGINT AS n FROM {PARTS} WHERE member >= 'p1' AND member <= 'p2'", lambda t: ranked.lex_count(parts(t), "[p1", "[p2"))
query("zcard", f"SELECT count(*)::BIGINT AS n FROM {PARTS}", lambda t: ranked.card(parts(t)))


def asked(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("p1",), ("p77",), ("p150",), ("none",)], "member string")


ASKED = "(VALUES ('p1'), ('p77'), ('p150'), ('none')) a(member)"
query("zrank", f"SELECT a.member, rank::BIGINT AS rank, score FROM {ASKED} LEFT JOIN {RANKED} USING (member)", lambda t: ranked.rank(parts(t), asked(t)))
query("zrevrank", f"SELECT a.member, back::BIGINT AS rank, score FROM {ASKED} LEFT JOIN {RANKED} USING (member)", lambda t: ranked.rank(parts(t), asked(t), reverse=True))
query("zmscore", f"SELECT a.member, score FROM {ASKED} LEFT JOIN {PARTS} USING (member)", lambda t: ranked.score(parts(t), asked(t)))
query("zpopmin", f"SELECT member, score FROM {PARTS} ORDER BY score, member LIMIT 8", lambda t: ranked.pop(parts(t), 8)[0])
query("zpopmax_left", f"SELECT member, score FROM {RANKED} WHERE back >= 8", lambda t: ranked.pop(parts(t), 8, highest=True)[1])


def dearer(t: Tables) -> DataFrame:
    return t.part.where("p_partkey <= 60").select(F.concat(F.lit("p"), (F.col("p_partkey") + 190).cast("string")).alias("member"), (F.col("p_size") * 40.0).alias("score"))


DEARER = "(SELECT 'p' || (p_partkey + 190) AS member, p_size * 40.0::DOUBLE AS score FROM part WHERE p_partkey <= 60)"
BOTH = f"(SELECT coalesce(a.member, b.member) AS member, a.score AS old, b.score AS new FROM {PARTS} a FULL JOIN {DEARER} b ON a.member = b.member)"
query("zadd", f"SELECT member, coalesce(new, old) AS score FROM {BOTH}", lambda t: ranked.add(parts(t), dearer(t)))
query("zadd_gt", f"SELECT member, CASE WHEN old IS NULL OR new > old THEN new ELSE old END AS score FROM {BOTH}", lambda t: ranked.add(parts(t), dearer(t), bound="gt"))
query("zadd_nx", f"SELECT member, coalesce(old, new) AS score FROM {BOTH}", lambda t: ranked.add(parts(t), dearer(t), only="nx"))
query("zadd_xx", f"SELECT member, coalesce(new, old) AS score FROM {BOTH} WHERE old IS NOT NULL", lambda t: ranked.add(parts(t), dearer(t), only="xx"))
query("zincrby", f"SELECT member, round(coalesce(new, 0) + coalesce(old, 0), 4) AS score FROM {BOTH}", lambda t: ranked.add(parts(t), dearer(t), incr=True).select("member", F.round("score", 4).alias("score")))
query("zremrangebyscore", f"SELECT member, score FROM {PARTS} WHERE NOT (score >= 920 AND score <= 950)", lambda t: ranked.remove_by_score(parts(t), 920, 950))
query("zremrangebyrank", f"SELECT member, score FROM {RANKED} WHERE NOT rank BETWEEN 10 AND 29", lambda t: ranked.remove_by_rank(parts(t), 10, 29))
query("zremrangebylex", f"SELECT member, score FROM {PARTS} WHERE NOT (member >= 'p1' AND member < 'p2')", lambda t: ranked.remove_by_lex(parts(t), "[p1", "(p2"))
query("zrem", f"SELECT member, score FROM {PARTS} WHERE member NOT IN ('p1', 'p77', 'p150', 'none')", lambda t: ranked.remove(parts(t), asked(t)))
query("zrandmember", f"SELECT 10::BIGINT AS n, 10::BIGINT AS different, 10::BIGINT AS members FROM {PARTS} HAVING count(*) > 10", lambda t: drawn(t, 10))
query("zrandmember_repeats", f"SELECT (2 * count(*))::BIGINT AS n, (2 * count(*))::BIGINT AS members FROM {PARTS}", lambda t: drawn(t, -2 * t.part.count()).drop("different"))
query("zadd_lt", f"SELECT member, CASE WHEN old IS NULL OR new < old THEN new ELSE old END AS score FROM {BOTH}", lambda t: ranked.add(parts(t), dearer(t), bound="lt"))
query("zadd_changed", f"SELECT count(*) FILTER (old IS NULL OR new <> old)::BIGINT AS n FROM {BOTH} WHERE new IS NOT NULL", lambda t: ranked.add_count(parts(t), dearer(t), changed=True))
query("zadd_added", f"SELECT count(*) FILTER (old IS NULL)::BIGINT AS n FROM {BOTH}", lambda t: ranked.add_count(parts(t), dearer(t)))
query("zdiff_one", f"SELECT member, score FROM {PARTS}", lambda t: ranked.diff(parts(t)))
query("zinter_many", f"SELECT member, 60 * score AS score FROM {ZF}", lambda t: ranked.inter([totals(t, "F")] * 60).select("member", F.round("score", 4).alias("score")))
query("zmpop", f"SELECT 1 AS k, member, score FROM {PARTS} ORDER BY score DESC, member DESC LIMIT 5", lambda t: popped_first(t))
query("zrange_all", f"SELECT member, score, rank::BIGINT AS rank FROM {RANKED} ORDER BY rank", lambda t: ranked.by_rank(parts(t), 0, -1))
query("zrank_equal_scores", "SELECT o_custkey AS member, (row_number() OVER (ORDER BY o_custkey) - 1)::BIGINT AS rank FROM (SELECT DISTINCT o_custkey FROM orders)", lambda t: ranked.ranks(sets.members(t.orders, "o_custkey").withColumn("score", F.lit(1))).select("member", "rank"))


def drawn(t: Tables, n: int) -> DataFrame:
    """(rows, different members, rows that are members) of a sample."""
    return ranked.random_members(parts(t), n).join(parts(t).select("member", F.lit(1).alias("is")), "member", "left").agg(F.count("*").alias("n"), F.count_distinct("member").alias("different"), F.count("is").alias("members"))


def popped_first(t: Tables) -> DataFrame:
    k, out, _ = ranked.pop_first([parts(t).limit(0), parts(t)], 5, highest=True)
    return out.select(F.lit(k).alias("k"), "member", "score")


# Sort


def elements(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").cast("string").alias("element"))


def weights(t: Tables) -> DataFrame:
    return t.supplier.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("w_"), F.col("s_suppkey").cast("string")).alias("key"), F.lit("bal").alias("field"), F.col("s_acctbal").cast("string").alias("value"))


S_ = "(SELECT s_suppkey::VARCHAR AS element, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal ELSE 0 END AS w, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS v FROM supplier)"
query("sort_numeric_desc_limit", "SELECT s_suppkey::VARCHAR AS element FROM supplier ORDER BY s_suppkey DESC LIMIT 10 OFFSET 2", lambda t: sorting.sort(elements(t), desc=True, offset=2, count=10))
query("sort_alpha", "SELECT s_suppkey::VARCHAR AS element FROM supplier ORDER BY s_suppkey::VARCHAR LIMIT 15", lambda t: sorting.sort(elements(t), alpha=True, count=15))
query("sort_by_get", f"SELECT element, element AS get_0, v AS get_1 FROM {S_} ORDER BY w, element LIMIT 20", lambda t: sorting.sort(elements(t), by="w_*->bal", table=weights(t), get=["#", "w_*->bal"], count=20).withColumn("get_1", F.col("get_1").cast("double")))

# Counters, sketches, bits

query("incr_counter", "SELECT user_id, count(*)::BIGINT AS value FROM events GROUP BY 1", lambda t: counters.incr(t.events, ["user_id"]))
query("hincrby", "SELECT user_id, event_type, count(*)::BIGINT AS value FROM events GROUP BY ALL", lambda t: counters.incr(t.events, ["user_id", "event_type"]))
query("incrbyfloat", "SELECT user_id, round(sum(value), 4) AS value FROM events GROUP BY 1", lambda t: counters.incr(t.events, ["user_id"], "value").select("user_id", F.round("value", 4).alias("value")))
query("lengths", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1", lambda t: counters.lengths(t.events, ["event_type"]))
#: Twice the standard error of a sketch, 1.04 / sqrt(2 ** 14).
HLL_ERROR = 0.0163
query("pfcount", "SELECT event_type, true AS close FROM events GROUP BY 1", lambda t: counters.pfcount(counters.pfadd(t.events, ["event_type"], "user_id")).join(t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact")), "event_type").select("event_type", (F.abs(F.col("n") - F.col("exact")) <= HLL_ERROR * F.col("exact")).alias("close")))
query("pfmerge", "SELECT true AS close", lambda t: counters.pfcount(counters.pfmerge(counters.pfadd(t.events, ["event_type"], "event_id"))).crossJoin(t.events.agg(F.count_distinct("event_id").alias("exact"))).select((F.abs(F.col("n") - F.col("exact")) <= HLL_ERROR * F.col("exact")).alias("close")))
for _op in ("and", "or", "xor"):
    query(f"bitop_{_op}", f"SELECT l_returnflag, bit_{_op}(l_partkey)::BIGINT AS bits FROM lineitem GROUP BY 1", lambda t, op=_op: counters.bitop(t.lineitem, ["l_returnflag"], "l_partkey", op))
BYTES = "list_transform(string_split({}, ''), lambda x: ascii(x))"
query("bitop_not", f"SELECT p_partkey, array_to_string(list_transform({BYTES.format('p_name')}, lambda x: printf('%02X', 255 - x)), '') AS bits FROM part", lambda t: t.part.select("p_partkey", F.hex(strings.bitop("not", F.col("p_name"))).alias("bits")))
for _op, _sql in (("and", "x & y"), ("or", "x | y"), ("xor", "xor(x, y)")):
    query(f"bitop_strings_{_op}", f"SELECT p_partkey, array_to_string(list_transform(list_zip({BYTES.format('p_name')}, {BYTES.format('p_brand')}), lambda z: printf('%02X', {_sql.replace('x,', 'coalesce(z[1], 0),').replace('x ', 'coalesce(z[1], 0) ').replace('y', 'coalesce(z[2], 0)')})), '') AS bits FROM part", lambda t, op=_op: t.part.select("p_partkey", F.hex(strings.bitop(op, F.col("p_name"), F.col("p_brand"))).alias("bits")))
query("bitcount", "SELECT l_returnflag, sum(bit_count(l_partkey))::BIGINT AS n FROM lineitem GROUP BY 1", lambda t: counters.bitcount(t.lineitem, ["l_returnflag"], "l_partkey"))
NAME_BITS = "(SELECT p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ''), lambda x: lpad(bin(ascii(x)), 8, '0')), '') AS b FROM part)"
query("str_bits", f"SELECT p_partkey, substr(b, 11, 1)::INTEGER AS bit, instr(b, '0')::INTEGER - 1 AS zero, instr(b, '1')::INTEGER - 1 AS one, length(replace(b, '0', ''))::INTEGER AS n FROM {NAME_BITS}", lambda t: t.part.select("p_partkey", strings.getbit(F.col("p_name"), 10).alias("bit"), strings.bitpos(F.col("p_name"), 0).alias("zero"), strings.bitpos(F.col("p_name"), 1).alias("one"), strings.bitcount(F.col("p_name")).alias("n")))
query("str_bits_range", f"SELECT p_partkey, length(replace(substr(b, 9, 16), '0', ''))::INTEGER AS n, length(replace(substr(b, 4, 10), '0', ''))::INTEGER AS m, CASE WHEN instr(substr(b, 17), '1') > 0 THEN instr(substr(b, 17), '1')::INTEGER + 15 ELSE -1 END AS one, CASE WHEN instr(substr(b, 6, 2), '0') > 0 THEN instr(substr(b, 6, 2), '0')::INTEGER + 4 ELSE -1 END AS zero FROM {NAME_BITS}", lambda t: t.part.select("p_partkey", strings.bitcount(F.col("p_name"), 1, 2).alias("n"), strings.bitcount(F.col("p_name"), 3, 12, "bit").alias("m"), strings.bitpos(F.col("p_name"), 1, 2).alias("one"), strings.bitpos(F.col("p_name"), 0, 5, 6, "bit").alias("zero")))
query("bitfield_strings", f"SELECT p_partkey, substr(b, 6, 12)::BIT::VARCHAR AS u12, (CASE WHEN substr(b, 10, 1) = '1' THEN -32 ELSE 0 END + (('0b0' || substr(b, 11, 5))::INTEGER))::BIGINT AS i6 FROM {NAME_BITS}", lambda t: t.part.select("p_partkey", F.lpad(F.bin(strings.field_get(F.col("p_name"), "u12", 5)), 12, "0").alias("u12"), strings.field_get(F.col("p_name"), "i6", 9).alias("i6")))
query("bitfield_strings_set", "SELECT p_partkey, 'Z' || substr(p_name, 2) AS changed FROM part", lambda t: t.part.select("p_partkey", strings.field_set(F.col("p_name"), "u8", 0, ord("Z")).cast("string").alias("changed")))
query("bitfield_strings_incr", "SELECT p_partkey, substr(p_name, 1, 1) || chr(ascii(substr(p_name, 2, 1)) + 1) || substr(p_name, 3) AS changed, (ascii(substr(p_name, 2, 1)) + 1)::BIGINT AS value, 127::BIGINT AS most, p_name AS failed FROM part", lambda t: incremented(t))
query("str_setbit", "SELECT p_partkey, chr(ascii(p_name) | 2) || substr(p_name, 2) AS changed FROM part", lambda t: t.part.select("p_partkey", strings.setbit(F.col("p_name"), 6, 1).cast("string").alias("changed")))
query("bitfield", "SELECT p_partkey, ((p_partkey >> 3) & 15)::BIGINT AS u4, (CASE WHEN (p_partkey & 15) >= 8 THEN (p_partkey & 15) - 16 ELSE p_partkey & 15 END)::BIGINT AS i4, least(p_size + 100, 127)::BIGINT AS sat, (CASE WHEN p_size + 100 > 127 THEN p_size + 100 - 256 ELSE p_size + 100 END)::BIGINT AS wrap, (CASE WHEN p_size + 100 <= 127 THEN p_size + 100 END)::BIGINT AS fail FROM part", lambda t: t.part.select("p_partkey", strings.bitfield_get(F.col("p_partkey"), 4, 3).alias("u4"), strings.bitfield_get(F.col("p_partkey"), 4, 0, signed=True).alias("i4"), *(strings.bitfield_incr(F.col("p_size"), 100, 8, how).alias(how) for how in ("sat", "wrap", "fail"))))
query("bitfield_set", "SELECT p_partkey, ((p_partkey & ~120) | 40)::BIGINT AS v FROM part", lambda t: t.part.select("p_partkey", strings.bitfield_set(F.col("p_partkey"), 4, 3, 5).alias("v")))



def incremented(t: Tables) -> DataFrame:
    up, sat, fail = (strings.field_incr(F.col("p_name"), kind, 8, by, how) for kind, by, how in (("u8", 1, "wrap"), ("i8", 120, "sat"), ("i8", 120, "fail")))
    return t.part.select("p_partkey", up[0].cast("string").alias("changed"), up[1].alias("value"), sat[1].alias("most"), fail[0].cast("string").alias("failed"))


# Strings

query("str_getrange", "SELECT p_partkey, substr(p_name, 2, 4) AS a, substr(p_name, length(p_name) - 2, 3) AS b, '' AS c FROM part", lambda t: t.part.select("p_partkey", strings.getrange(F.col("p_name"), 1, 4).alias("a"), strings.getrange(F.col("p_name"), -3, -1).alias("b"), strings.getrange(F.col("p_name"), -1, -3).alias("c")))
query("str_setrange", "SELECT p_partkey, substr(p_name, 1, 2) || 'XY' || substr(p_name, 5) AS v FROM part", lambda t: t.part.select("p_partkey", strings.setrange(F.col("p_name"), 2, "XY").alias("v")))
query("str_getrange_bytes", "SELECT p_partkey, substr(hex(encode('é' || p_name)), 3, 6) AS a, right(hex(encode(p_name || 'é')), 2) AS b FROM part", lambda t: t.part.select("p_partkey", F.hex(strings.getrange(F.concat(F.lit("é"), "p_name"), 1, 3)).alias("a"), F.hex(strings.getrange(F.concat("p_name", F.lit("é")), -1, -1)).alias("b")))
query("str_setrange_bytes", "SELECT p_partkey, 'C358' || substr(hex(encode('é' || p_name)), 5) AS a, hex(encode(p_brand)) || repeat('00', 20 - strlen(p_brand)::INTEGER) || '78' AS b FROM part", lambda t: t.part.select("p_partkey", F.hex(strings.setrange(F.concat(F.lit("é"), "p_name"), 1, "X")).alias("a"), F.hex(strings.setrange(F.col("p_brand"), 20, "x")).alias("b")))
query("str_append_len", "SELECT p_partkey, p_name || p_brand AS v, strlen(p_name)::INTEGER AS n FROM part", lambda t: t.part.select("p_partkey", strings.append(F.col("p_name"), F.col("p_brand")).alias("v"), strings.strlen(F.col("p_name")).alias("n")))
#: Row by row of the table of lengths: each is the running maximum of the one before and of matches one further.
LCS = """WITH RECURSIVE p AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part),
r AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: 0) AS l FROM p
UNION ALL SELECT a, b, i + 1, list_transform(range(length(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda m: CASE WHEN m > 0 AND a[i + 1] = b[m] THEN l[m] + 1 ELSE l[m + 1] END))) FROM r WHERE i < length(a))
SELECT p_partkey, list_max(l)::INTEGER AS n FROM part JOIN r ON a = p_name AND b = lower(p_type) WHERE i = length(a)"""
query("lcs_len", LCS, lambda t: t.part.select("p_partkey", F.length(strings.lcs(F.col("p_name"), F.lower("p_type"))).alias("n")))
query("lcs_idx", None, lambda t: t.part.select("p_partkey", strings.lcs_idx(F.col("p_name"), F.lower("p_type"), 2).alias("matches")))
query("str_tokens", "SELECT p_partkey, list_filter(string_split(p_name, 'e'), lambda x: x <> '') AS tokens, coalesce(string_split(p_name, 'e')[2], '') AS second, trim(p_name) AS trimmed, array_to_string(list_filter(string_split(p_name, 'e'), lambda x: x <> ''), '-') AS joined FROM part", lambda t: t.part.select("p_partkey", strings.tokens(F.col("p_name"), "e").alias("tokens"), strings.token(F.col("p_name"), "e", 1).alias("second"), strings.trim(F.concat(F.lit(" "), "p_name", F.lit("  "))).alias("trimmed"), strings.join(strings.tokens(F.col("p_name"), "e"), "-").alias("joined")))

# Key spaces


def space(t: Tables) -> DataFrame:
    until = F.when(F.col("c_custkey") % 2 == 0, F.timestamp_seconds(F.col("c_custkey") * 3600 + F.lit(1_700_000_000)))
    return t.customer.select(F.col("c_name").alias("key"), F.lower("c_mktsegment").alias("type"), F.col("c_acctbal").cast("string").alias("value"), until.alias("expires_at"))


query("keys_match", "SELECT DISTINCT c_name AS key FROM customer WHERE regexp_matches(c_name, '^Customer#0+[1-4].$')", lambda t: keys.scan(space(t), "Customer#0*[1-4]?").where(F.col("key").rlike("^Customer#0+[1-4].$")))
query("keys_type", "SELECT DISTINCT c_name AS key FROM customer WHERE lower(c_mktsegment) = 'building' AND c_name LIKE 'Customer#%5'", lambda t: keys.scan(space(t), "Customer#*5", "building"))
query("ttl_filter", "SELECT c_name AS key FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey * 3600 > 360000", lambda t: keys.live(space(t), "2023-11-19 02:13:20").select("key"))
query("ttl", "SELECT c_name AS key, (CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 3600 - 360000 ELSE -1 END)::BIGINT AS ttl FROM customer", lambda t: keys.ttl(space(t), "2023-11-19 02:13:20"))
query("get_missing", "SELECT key, c_acctbal AS value FROM (VALUES ('Customer#000000001'), ('none')) a(key) LEFT JOIN customer ON c_name = key", lambda t: keys.get(space(t), t.spark.createDataFrame([("Customer#000000001",), ("none",)], "key string")).select("key", F.col("value").cast("double").alias("value")))
query("set_if_missing", "SELECT c_name AS key, c_acctbal AS value FROM customer UNION ALL SELECT 'new', 1.5", lambda t: keys.put(space(t), t.spark.createDataFrame([("Customer#000000001", "0"), ("new", "1.5")], "key string, value string"), only="nx").select("key", F.col("value").cast("double").alias("value")))
query("mset", "SELECT c_name AS key, CASE WHEN c_name = 'Customer#000000001' THEN 0 ELSE c_acctbal END AS value FROM customer UNION ALL SELECT 'new', 1.5", lambda t: keys.put(space(t), t.spark.createDataFrame([("Customer#000000001", "0"), ("new", "1.5")], "key string, value string")).select("key", F.col("value").cast("double").alias("value")))
query("keys_delete_rename", "SELECT CASE WHEN c_custkey = 1 THEN 'first' ELSE c_name END AS key FROM customer WHERE c_custkey <> 2", lambda t: keys.rename(keys.delete(space(t), t.customer.where("c_custkey = 2").select(F.col("c_name").alias("key"))), "Customer#000000001", "first").select("key"))



def named(t: Tables, *names: str) -> DataFrame:
    return t.spark.createDataFrame([(n,) for n in names], "key string")


def news(t: Tables) -> DataFrame:
    """A new value for a key that is there, with and without an expiry, and for one that isn't."""
    return t.spark.createDataFrame([("Customer#000000001", "0"), ("Customer#000000002", "0"), ("new", "1.5")], "key string, value string")


FIRST, SECOND = "Customer#000000001", "Customer#000000002"
NOW, UNTIL = "2023-11-19 02:13:20", "2023-11-19 02:14:20"
SPACE = "(SELECT c_name AS key, lower(c_mktsegment) AS type, c_acctbal AS value, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 3600 - 360000 END AS ttl FROM customer)"
SET_BY_NAME = f"key IN ('{FIRST}', '{SECOND}')"


def seen(space_: DataFrame) -> DataFrame:
    """(key, type, value, ttl) of a key space, as the SQL has them."""
    left = F.col("expires_at").cast("timestamp").cast("double") - F.lit(NOW).cast("timestamp").cast("double")
    return space_.select("key", "type", F.col("value").cast("double").alias("value"), F.round(left).cast("long").alias("ttl"))


def until() -> Column:
    return F.lit(UNTIL).cast("timestamp")


query("set_types_and_expiry", f"SELECT key, CASE WHEN {SET_BY_NAME} THEN 'string' ELSE type END AS type, CASE WHEN {SET_BY_NAME} THEN 0 ELSE value END AS value, CASE WHEN NOT {SET_BY_NAME} THEN ttl END::BIGINT AS ttl FROM {SPACE} UNION ALL SELECT 'new', 'string', 1.5, NULL", lambda t: seen(keys.put(space(t), news(t))))
query("set_ex", f"SELECT key, CASE WHEN {SET_BY_NAME} THEN 'string' ELSE type END AS type, CASE WHEN {SET_BY_NAME} THEN 0 ELSE value END AS value, CASE WHEN {SET_BY_NAME} THEN 60 ELSE ttl END::BIGINT AS ttl FROM {SPACE} UNION ALL SELECT 'new', 'string', 1.5, 60", lambda t: seen(keys.put(space(t), news(t), expires_at=until())))
query("set_xx_keepttl", f"SELECT key, CASE WHEN {SET_BY_NAME} THEN 'string' ELSE type END AS type, CASE WHEN {SET_BY_NAME} THEN 0 ELSE value END AS value, ttl::BIGINT AS ttl FROM {SPACE}", lambda t: seen(keys.put(space(t), news(t), only="xx", keep_ttl=True)))
query("set_nx_keeps_rows", f"SELECT key, type, value, ttl::BIGINT AS ttl FROM {SPACE} UNION ALL SELECT 'new', 'string', 1.5, NULL", lambda t: seen(keys.put(space(t), news(t), only="nx")))
query("msetnx", f"SELECT key, type, value, ttl::BIGINT AS ttl FROM {SPACE}", lambda t: seen(keys.put_all_if_free(space(t), news(t))))
query("msetnx_free", f"SELECT key, type, value, ttl::BIGINT AS ttl FROM {SPACE} UNION ALL SELECT 'new', 'string', 1.5, NULL", lambda t: seen(keys.put_all_if_free(space(t), news(t).where("key = 'new'"))))
query("set_get", f"SELECT a.key, value FROM (VALUES ('{FIRST}'), ('{SECOND}'), ('new')) a(key) LEFT JOIN {SPACE} USING (key)", lambda t: keys.get_and_put(space(t), news(t))[0].select("key", F.col("value").cast("double").alias("value")))
query("getex", f"SELECT key, type, value, CASE WHEN {SET_BY_NAME} THEN 60 ELSE ttl END::BIGINT AS ttl FROM {SPACE}", lambda t: seen(keys.get_and_expire(space(t), named(t, FIRST, SECOND), until())[1]))
query("getex_persist", f"SELECT key, type, value, CASE WHEN NOT {SET_BY_NAME} THEN ttl END::BIGINT AS ttl FROM {SPACE}", lambda t: seen(keys.get_and_expire(space(t), named(t, FIRST, SECOND))[1]))
query("getdel", f"SELECT key, type, value, ttl::BIGINT AS ttl FROM {SPACE} WHERE NOT {SET_BY_NAME}", lambda t: seen(keys.get_and_delete(space(t), named(t, FIRST, SECOND))[1]))
query("keys_copy", f"SELECT key, type, value, ttl::BIGINT AS ttl FROM {SPACE} UNION ALL SELECT 'copied', type, value, ttl FROM {SPACE} WHERE key = '{SECOND}'", lambda t: seen(keys.copy(space(t), SECOND, "copied")))
query("keys_copy_taken", f"SELECT key, type, value, ttl::BIGINT AS ttl FROM {SPACE}", lambda t: seen(keys.copy(space(t), SECOND, FIRST)))
query("keys_copy_replace", f"SELECT key, type, value, ttl::BIGINT AS ttl FROM {SPACE} WHERE key <> '{FIRST}' UNION ALL SELECT '{FIRST}', type, value, ttl FROM {SPACE} WHERE key = '{SECOND}'", lambda t: seen(keys.copy(space(t), SECOND, FIRST, replace=True)))
query("keys_rename_taken", f"SELECT CASE WHEN key = '{SECOND}' THEN '{FIRST}' ELSE key END AS key, type, value, ttl::BIGINT AS ttl FROM {SPACE} WHERE key <> '{FIRST}'", lambda t: seen(keys.rename(space(t), SECOND, FIRST)))
query("keys_rename_itself", f"SELECT key, type, value, ttl::BIGINT AS ttl FROM {SPACE}", lambda t: seen(keys.rename(keys.rename(space(t), FIRST, FIRST), SECOND, FIRST, only_free=True)))
for _only, _when in (("xx", "ttl IS NOT NULL"), ("gt", "ttl IS NOT NULL AND 60 > ttl"), ("lt", "ttl IS NULL OR 60 < ttl")):
    query(f"keys_expire_{_only}", f"SELECT key, type, value, CASE WHEN {_when} THEN 60 ELSE ttl END::BIGINT AS ttl FROM {SPACE}", lambda t, only=_only: seen(keys.expire(space(t), t.customer.select(F.col("c_name").alias("key")), until(), only)))
query("keys_persist", f"SELECT key, type, value, CASE WHEN NOT {SET_BY_NAME} THEN ttl END::BIGINT AS ttl FROM {SPACE}", lambda t: seen(keys.persist(space(t), named(t, FIRST, SECOND, "none"))))
query("pttl_asked", f"SELECT a.key, CASE WHEN b.key IS NULL THEN -2 WHEN ttl IS NULL THEN -1 ELSE ttl * 1000 END::BIGINT AS ttl FROM (VALUES ('{FIRST}'), ('{SECOND}'), ('none')) a(key) LEFT JOIN {SPACE} b ON a.key = b.key", lambda t: keys.ttl(space(t), NOW, named(t, FIRST, SECOND, "none"), milliseconds=True))
query("keys_exists_type", f"SELECT a.key, type FROM (VALUES ('{FIRST}'), ('none')) a(key) LEFT JOIN {SPACE} USING (key)", lambda t: keys.exists(space(t), named(t, FIRST, "none")))


def swept(t: Tables) -> DataFrame:
    """Active expiry over a stored key space."""
    from gneiss.streaming.stores import Store, expire_now

    store = Store(t.spark, folder(t))
    store.write(space(t))
    expire_now(store, NOW)
    return seen(store.read())


query("keys_active_expiry", f"SELECT key, type, value, ttl::BIGINT AS ttl FROM {SPACE} WHERE ttl IS NULL OR ttl > 0", swept)

# Lists and hashes


def baskets(t: Tables) -> DataFrame:
    own = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("x"))
    return own.select("l_orderkey", F.transform("x", lambda s: s["l_partkey"]).alias("l"), F.transform("x", lambda s: s["l_returnflag"]).alias("f"))


LIST = "(SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS l, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS f FROM lineitem GROUP BY 1)"
query("list_index", f"SELECT l_orderkey, l[1] AS a, l[-1] AS b, l[3] AS c, len(l)::INTEGER AS n FROM {LIST}", lambda t: baskets(t).select("l_orderkey", lists.lindex(F.col("l"), 0).alias("a"), lists.lindex(F.col("l"), -1).alias("b"), lists.lindex(F.col("l"), 2).alias("c"), F.size("l").alias("n")))
query("list_range", f"SELECT l_orderkey, array_to_string(l[2:4], ',') AS a, array_to_string(l[-2:], ',') AS b FROM {LIST}", lambda t: baskets(t).select("l_orderkey", F.array_join(lists.lrange(F.col("l"), 1, 3), ",").alias("a"), F.array_join(lists.lrange(F.col("l"), -2, -1), ",").alias("b")))
query("list_pos", f"SELECT l_orderkey, (list_position(f, 'R') - 1)::INTEGER AS first, len(list_filter(f, lambda x: x = 'R'))::INTEGER AS n FROM {LIST}", lambda t: baskets(t).select("l_orderkey", lists.lpos(F.col("f"), "R").alias("first"), F.size(lists.lpos(F.col("f"), "R", count=0)).alias("n")))
query("list_rem_all", f"SELECT l_orderkey, array_to_string(list_filter(f, lambda x: x <> 'R'), ',') AS f FROM {LIST}", lambda t: baskets(t).select("l_orderkey", F.array_join(lists.lrem(F.col("f"), 0, "R"), ",").alias("f")))
query("list_rem_first", f"SELECT l_orderkey, regexp_replace(array_to_string(f, ''), 'R', '') AS f FROM {LIST}", lambda t: baskets(t).select("l_orderkey", F.array_join(lists.lrem(F.col("f"), 1, "R"), "").alias("f")))
query("list_push_pop", f"SELECT l_orderkey, 'b,a,' || array_to_string(f[1:len(f) - 1], ',') AS v, f[len(f)] AS popped FROM {LIST} WHERE len(f) > 1", lambda t: baskets(t).where("size(f) > 1").select("l_orderkey", F.array_join(lists.lpush(lists.rpop(F.col("f"))[1], "a", "b"), ",").alias("v"), lists.rpop(F.col("f"))[0][0].alias("popped")))
query("list_insert_set", f"SELECT l_orderkey, regexp_replace(array_to_string(f, ''), 'R', 'xR') AS a, 'z' || substr(array_to_string(f, ''), 2) AS b FROM {LIST}", lambda t: baskets(t).select("l_orderkey", F.array_join(lists.linsert(F.col("f"), "R", "x"), "").alias("a"), F.array_join(lists.lset(F.col("f"), 0, "z"), "").alias("b")))
query("list_move", f"SELECT l_orderkey, array_to_string(f[2:], '') AS a, f[1] || 'q' AS b FROM {LIST}", lambda t: baskets(t).select("l_orderkey", F.array_join(lists.lmove(F.col("f"), F.array(F.lit("q")))[0], "").alias("a"), F.array_join(lists.lmove(F.col("f"), F.array(F.lit("q")))[1], "").alias("b")))
query("list_mpop", f"SELECT l_orderkey, CASE WHEN len(f) > 3 THEN 0 ELSE 1 END AS k, CASE WHEN len(f) > 3 THEN array_to_string(list_reverse(f[-2:]), '') ELSE 'y' END AS popped, CASE WHEN len(f) > 3 THEN array_to_string(f[:len(f) - 2], '') ELSE '' END AS a, CASE WHEN len(f) > 3 THEN 'y' ELSE '' END AS b FROM {LIST}", lambda t: popped_lists(t))


def popped_lists(t: Tables) -> DataFrame:
    """LMPOP of two items from the right of a list that is empty in some rows, and of one that has one item."""
    a, b = F.when(F.size("f") > 3, F.col("f")).otherwise(F.array().cast("array<string>")), F.array(F.lit("y"))
    k, popped, left = lists.lmpop([a, b], 2, from_left=False)
    return baskets(t).select("l_orderkey", k.alias("k"), F.array_join(popped, "").alias("popped"), F.array_join(left[0], "").alias("a"), F.array_join(left[1], "").alias("b"))


def listed_store(t: Tables):
    from gneiss.streaming.stores import Store

    store = Store(t.spark, folder(t))
    store.write(baskets(t).select(F.col("l_orderkey").cast("string").alias("key"), F.col("f").alias("value")))
    return store


def left_by_blpop(t: Tables) -> DataFrame:
    """The lists of a store after a blocking pop of the second of two names, the first being none."""
    from gneiss.streaming.stores import blpop

    store = listed_store(t)
    blpop(store, ["none", "1"], timeout=5)
    return store.read().select("key", F.array_join("value", "").alias("f"))


def left_by_bzpop(t: Tables) -> DataFrame:
    from gneiss.streaming.stores import Store, bzpopmin

    store = Store(t.spark, folder(t))
    store.write(parts(t).select(F.lit("z").alias("key"), "member", "score"))
    bzpopmin(store, ["none", "z"], timeout=5, n=3)
    return store.read().select("member", "score")


query("list_blocking_pop", f"SELECT l_orderkey::VARCHAR AS key, CASE WHEN l_orderkey = 1 THEN array_to_string(f[2:], '') ELSE array_to_string(f, '') END AS f FROM {LIST} WHERE l_orderkey <> 1 OR len(f) > 1", left_by_blpop)
query("zset_blocking_pop", f"SELECT member, score FROM {RANKED} WHERE rank >= 3", left_by_bzpop)


def hashes(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string")).alias("h"))


query("hash_get_set", "SELECT s_suppkey, s_name AS name, NULL::VARCHAR AS missing, 'x' AS changed, 3::INTEGER AS n, (s_nationkey + 5)::VARCHAR AS more, strlen(s_name)::INTEGER AS size FROM supplier", lambda t: hashes(t).select("s_suppkey", lists.hget(F.col("h"), "name").alias("name"), lists.hget(F.col("h"), "none").alias("missing"), lists.hget(lists.hset(F.col("h"), name="x", more="y"), "name").alias("changed"), lists.hlen(lists.hset(F.col("h"), name="x", more="y")).alias("n"), lists.hget(lists.hincrby(F.col("h"), "nation", 5), "nation").alias("more"), lists.hstrlen(F.col("h"), "name").alias("size")))
query("hash_keys_vals", "SELECT s_suppkey, 'name,nation' AS k, s_name || ',' || s_nationkey AS v, true AS has, 'nation' AS left_over FROM supplier", lambda t: hashes(t).select("s_suppkey", F.array_join(lists.hkeys(F.col("h")), ",").alias("k"), F.array_join(lists.hvals(F.col("h")), ",").alias("v"), lists.hexists(F.col("h"), "name").alias("has"), F.array_join(lists.hkeys(lists.hdel(F.col("h"), "name")), ",").alias("left_over")))
query("hash_getall", "SELECT s_suppkey, unnest(['name', 'nation']) AS key, unnest([s_name, s_nationkey::VARCHAR]) AS value FROM supplier", lambda t: hashes(t).select("s_suppkey", F.inline(lists.hgetall(F.col("h")))))

query("hash_scan", "SELECT s_suppkey, 'name' AS key, s_name AS value FROM supplier", lambda t: hashes(t).select("s_suppkey", F.inline(lists.hscan(F.col("h"), "na[l-m]?"))))
query("hash_random_field", "SELECT s_suppkey, 1 AS n, 2 AS all, 1 AS fields FROM supplier", lambda t: hashes(t).select("s_suppkey", lists.hrandfield(F.col("h"), 1).alias("one"), lists.hrandfield(F.col("h"), 5).alias("more")).select("s_suppkey", F.size("one").alias("n"), F.size("more").alias("all"), F.col("one")[0].isin("name", "nation").cast("int").alias("fields")))

# Places


def places(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.alias("member"), ((k * 37) % 360 - 180).cast("double").alias("lon"), ((k * 17) % 170 - 85).cast("double").alias("lat"))


PLACES = "(SELECT c_custkey AS member, ((c_custkey * 37) % 360 - 180)::DOUBLE AS lon, ((c_custkey * 17) % 170 - 85)::DOUBLE AS lat FROM customer)"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * 6372797.560856 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"


FROM_ROME = haversine("12.5", "41.9", "lon", "lat")
query("geodist", f"SELECT member, round({FROM_ROME} / 1000, 3) AS km FROM {PLACES}", lambda t: places(t).select("member", F.round(geo.distance(F.lit(12.5), F.lit(41.9), F.col("lon"), F.col("lat"), "km"), 3).alias("km")))
query("geosearch_radius", f"SELECT member, round({FROM_ROME} / 1000, 3) AS dist FROM {PLACES} WHERE {FROM_ROME} <= 3000000", lambda t: geo.search(places(t), 12.5, 41.9, radius=3000, unit="km").select("member", F.round("dist", 3).alias("dist")))
query("geosearch_nearest", f"SELECT member, round({FROM_ROME} / 1000, 3) AS dist FROM {PLACES} WHERE {FROM_ROME} <= 5000000 ORDER BY {FROM_ROME}, member LIMIT 7", lambda t: geo.search(places(t), 12.5, 41.9, radius=5000, unit="km", count=7).select("member", F.round("dist", 3).alias("dist")))
query("geosearch_box", f"SELECT member FROM {PLACES} WHERE {haversine('12.5', '41.9', '12.5', 'lat')} <= 1500000 AND {haversine('12.5', 'lat', 'lon', 'lat')} <= 2000000", lambda t: geo.search(places(t), 12.5, 41.9, box=(4000, 3000), unit="km").select("member"))
query("geosearch_member", f"SELECT p.member FROM {PLACES} p, (SELECT lon AS x, lat AS y FROM {PLACES} WHERE member = 7) q WHERE {haversine('x', 'y', 'lon', 'lat')} <= 2000000", lambda t: geo.search_from(places(t), 7, radius=2000, unit="km").select("member"))
query("geo_roundtrip", f"SELECT member, lon, lat FROM {PLACES}", lambda t: places(t).select("member", geo.position(geo.geohash_bits(F.col("lon"), F.col("lat"))).alias("p")).select("member", (F.round("p.lon", 3) + 0.0).alias("lon"), (F.round("p.lat", 3) + 0.0).alias("lat")))
query("geosearch_store", f"SELECT member, round({FROM_ROME} / 1000, 3) AS score FROM {PLACES} WHERE {FROM_ROME} <= 3000000", lambda t: geo.search_store(places(t), 12.5, 41.9, store_dist=True, radius=3000, unit="km").select("member", F.round("score", 3).alias("score")))
query("geosearch_store_hash", f"SELECT member, lon, lat FROM {PLACES} WHERE {FROM_ROME} <= 3000000", lambda t: geo.search_store(places(t), 12.5, 41.9, radius=3000, unit="km").select("member", geo.position(F.col("score").cast("long")).alias("p")).select("member", (F.round("p.lon", 3) + 0.0).alias("lon"), (F.round("p.lat", 3) + 0.0).alias("lat")))
query("geosearch_withcoord", f"SELECT member, round({FROM_ROME} / 1000, 3) AS dist, lon AS x, lat AS y FROM {PLACES} WHERE {FROM_ROME} <= 3000000", lambda t: geo.search(places(t), 12.5, 41.9, radius=3000, unit="km", with_coord=True, with_hash=True).where("hash IS NOT NULL").select("member", F.round("dist", 3).alias("dist"), (F.round("coord.lon", 3) + 0.0).alias("x"), (F.round("coord.lat", 3) + 0.0).alias("y")))
CELL = "least(floor(({c} + {limit}) / {size} * 67108864), 67108863)::BIGINT"
HASHED = f"(SELECT member, {CELL.format(c='lon', limit=180.0, size=360.0)} AS x, {CELL.format(c='((' + CELL.format(c='lat', limit=85.05112878, size=170.10225756) + ' + 0.5) / 67108864 * 170.10225756 - 85.05112878)', limit=90.0, size=180.0)} AS y FROM {PLACES})"
query("geohash_text", f"SELECT member, array_to_string(list_transform(range(10), lambda j: substr('{geo.BASE32}', ('0b0' || substr(b, (5 * j + 1)::INTEGER, 5))::INTEGER + 1, 1)), '') || '0' AS hash FROM (SELECT member, array_to_string(list_transform(range(26), lambda k: ((x >> (25 - k)::INTEGER) & 1)::VARCHAR || ((y >> (25 - k)::INTEGER) & 1)::VARCHAR), '') AS b FROM {HASHED})", lambda t: places(t).select("member", geo.geohash(geo.geohash_bits(F.col("lon"), F.col("lat"))).alias("hash")))

# Logs


def log(t: Tables) -> DataFrame:
    return t.events.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"), "user_id", "event_type")


LOG = "(SELECT epoch_us(ts) // 1000 AS ms, event_id AS seq, user_id, event_type FROM events)"
FROM, TO = 1704672000000, 1705276800000
query("xrange", f"SELECT * FROM {LOG} WHERE ms >= {FROM} AND ms <= {TO} ORDER BY ms, seq LIMIT 50", lambda t: logs.xrange(log(t), FROM, TO, 50))
query("xrevrange", f"SELECT * FROM {LOG} WHERE ms <= {TO} ORDER BY ms DESC, seq DESC LIMIT 30", lambda t: logs.xrange(log(t), "-", TO, 30, reverse=True))
query("xread_after", f"SELECT * FROM {LOG} WHERE ms > {FROM} OR (ms = {FROM} AND seq > 5) ORDER BY ms, seq LIMIT 25", lambda t: logs.xread(log(t), f"{FROM}-5", 25))
query("xlen", f"SELECT count(*)::BIGINT AS n FROM {LOG}", lambda t: logs.xlen(log(t)))
query("xtrim_maxlen", f"SELECT * FROM {LOG} ORDER BY ms DESC, seq DESC LIMIT 100", lambda t: logs.xtrim(log(t), maxlen=100))
query("xtrim_minid", f"SELECT * FROM {LOG} WHERE ms >= {TO}", lambda t: logs.xtrim(log(t), minid=TO))
query("xdel", f"SELECT * FROM {LOG} WHERE seq % 10 <> 0", lambda t: logs.xdel(log(t), log(t).where("seq % 10 = 0")))
query("xinfo", f"SELECT count(*)::BIGINT AS length, arg_min(ms, {{'a': ms, 'b': seq}}) AS first_ms, arg_min(seq, {{'a': ms, 'b': seq}}) AS first_seq, arg_max(ms, {{'a': ms, 'b': seq}}) AS last_ms, arg_max(seq, {{'a': ms, 'b': seq}}) AS last_seq FROM {LOG}", lambda t: logs.xinfo(log(t)))
query("xadd", f"SELECT ms, seq FROM {LOG} UNION ALL SELECT 1900000000000, row_number() OVER (ORDER BY event_id) - 1 FROM events WHERE event_type = 'error'", lambda t: logs.xadd(log(t).select("ms", "seq"), t.events.where("event_type = 'error'").select("event_id"), ["event_id"], F.lit(1_900_000_000_000)))


def pending(t: Tables) -> DataFrame:
    """Entries before a time, delivered to a consumer by user; clicks are acknowledged."""
    own = log(t).where(F.col("ms") < FROM)
    delivered = own.select("ms", "seq", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("consumer"), F.col("ms").alias("delivered_at"), F.lit(1).alias("times"))
    return logs.xack(delivered, own.where("event_type = 'click'"))


PENDING = f"(SELECT ms, seq, 'c' || (user_id % 3) AS consumer FROM {LOG} WHERE ms < {FROM} AND event_type <> 'click')"
query("xpending", f"SELECT consumer, count(*)::BIGINT AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM {PENDING} GROUP BY 1", lambda t: logs.xpending(pending(t)))
query("xpending_idle", f"SELECT ms, seq, consumer, {FROM} - ms AS idle, 1 AS times FROM {PENDING} WHERE {FROM} - ms >= 86400000 AND consumer = 'c1' ORDER BY ms, seq LIMIT 20", lambda t: logs.xpending(pending(t), FROM, 86400000, "c1", count=20))
query("xautoclaim", f"SELECT ms, seq, CASE WHEN r <= 40 THEN 'c9' ELSE consumer END AS consumer, CASE WHEN r <= 40 THEN 2 ELSE 1 END AS times FROM (SELECT *, row_number() OVER (ORDER BY ms, seq) AS r FROM {PENDING})", lambda t: logs.xautoclaim(pending(t), "c9", FROM, 1, count=40).select("ms", "seq", "consumer", "times"))
query("xreadgroup", f"SELECT ms, seq, 'a' AS consumer FROM {LOG} WHERE ms > {FROM} ORDER BY ms, seq LIMIT 30", lambda t: logs.xreadgroup(log(t), f"{FROM}-9223372036854775807", "a", TO, 30).select("ms", "seq", "consumer"))
query("xadd_several_ms", f"SELECT ms, seq FROM {LOG} UNION ALL SELECT 1900000000000 + user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 FROM events", lambda t: logs.xadd(log(t).select("ms", "seq"), t.events.select("event_id", "user_id"), ["event_id"], F.col("user_id") + F.lit(1_900_000_000_000)))
query("xadd_after_maxlen", "SELECT 1900000000000 AS ms, row_number() OVER (ORDER BY event_id) + 7 AS seq FROM events ORDER BY seq DESC LIMIT 20", lambda t: logs.xadd(log(t).select("ms", "seq"), t.events.select("event_id"), ["event_id"], F.lit(1_900_000_000_000), after=logs.xsetid(log(t), "1900000000000-7"), maxlen=20))
query("xread_many", f"(SELECT 'a' AS stream, * FROM {LOG} WHERE ms > {FROM} OR (ms = {FROM} AND seq > 5) ORDER BY ms, seq LIMIT 10) UNION ALL (SELECT 'b', * FROM {LOG} ORDER BY ms, seq LIMIT 10)", lambda t: logs.xread_many({"a": (log(t), f"{FROM}-5"), "b": (log(t), "0-0"), "c": (log(t), "$")}, 10))


def group(t: Tables) -> logs.Group:
    """A group from an ID on, of which one consumer has read 30 entries, another 20 without pending ones, then the first 15."""
    own = logs.Group.create(log(t), f"{FROM}-0").create_consumer("idle", 1)
    own = own.read(log(t), "a", 10, count=30)[1]
    own = own.read(log(t), "b", 20, count=20, noack=True)[1]
    return own.read(log(t), "a", 30, count=15)[1]


AFTER = f"(SELECT ms, seq, row_number() OVER (ORDER BY ms, seq) AS r FROM {LOG} WHERE ms > {FROM} OR (ms = {FROM} AND seq > 0))"
query("xgroup_read_count_noack", f"SELECT ms, seq, 'a' AS consumer, CASE WHEN r <= 30 THEN 10 ELSE 30 END::BIGINT AS delivered_at FROM {AFTER} WHERE r <= 30 OR r BETWEEN 51 AND 65", lambda t: group(t).pending.select("ms", "seq", "consumer", "delivered_at"))
query("xgroup_history", f"SELECT ms, seq FROM {AFTER} WHERE r BETWEEN 1 AND 5", lambda t: group(t).read(log(t), "a", 40, after="0-0", count=5)[0].select("ms", "seq"))
query("xgroup_setid", f"SELECT ms, seq FROM {AFTER} WHERE r <= 3", lambda t: group(t).set_id(log(t), f"{FROM}-0").read(log(t), "c", 50, count=3)[0].select("ms", "seq"))
query("xgroup_delconsumer", "SELECT 45::BIGINT AS gone, 0::BIGINT AS pending", lambda t: deleted(t))
query("xgroup_consumers", "SELECT * FROM (VALUES ('a', 45::BIGINT, 70::BIGINT), ('b', 0, 80), ('idle', 0, 99)) c(consumer, pending, idle)", lambda t: group(t).info(log(t), 100))
query("xgroup_create_at_end", "SELECT 0::BIGINT AS n", lambda t: logs.Group.create(log(t)).read(log(t), "a", 1)[0].agg(F.count("*").alias("n")))


def deleted(t: Tables) -> DataFrame:
    gone, left = group(t).delete_consumer("a")
    return left.pending.agg(F.lit(gone).cast("long").alias("gone"), F.count("*").alias("pending"))


query("window_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", lambda t: windowed(t.events, "ts", ["event_type"], "1 hour", value="value").select("start", "event_type", "n", F.round("total", 4).alias("total")))
query("session_counts", "SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minute THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s", lambda t: sessions(t.events, "ts", "user_id", "30 minutes").select("user_id", "start", "n"))

# Functions


def eval_script(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.round(evaluate(lambda x, y: x * 2 + y, "double", F.col("s_acctbal"), F.col("s_nationkey")), 4).alias("v"))


def fcall(t: Tables) -> DataFrame:
    """A function of a library that was dumped and restored."""
    first, second = Functions(t.spark), Functions(t.spark)
    first.load("gneiss_lib", {"gneiss_twice": (lambda x: x * 2, "double")})
    second.restore(first.dump())
    return t.supplier.select("s_suppkey", F.round(second.call("gneiss_twice", F.col("s_acctbal"), read_only=True), 4).alias("v"))


def functions_listed(t: Tables) -> DataFrame:
    own = Functions(t.spark)
    own.load("gneiss_a", {"gneiss_f": (lambda x: x, "long")})
    own.load("gneiss_b", {"gneiss_g": (lambda x: x, "double")})
    own.delete("gneiss_a")
    return own.list()


def by_digest(t: Tables) -> DataFrame:
    scripts = Scripts()
    digest = scripts.load("x * 2 + y")
    return t.supplier.select("s_suppkey", F.round(scripts.run(digest, "double", x=F.col("s_acctbal"), y=F.col("s_nationkey")), 4).alias("v"))


query("fcall", "SELECT s_suppkey, round(s_acctbal * 2, 4) AS v FROM supplier", fcall)
query("function_list", "SELECT 'gneiss_b' AS library, 'gneiss_g' AS name, 'double' AS returns", functions_listed)
query("eval_by_digest", "SELECT s_suppkey, round(s_acctbal * 2 + s_nationkey, 4) AS v FROM supplier", by_digest)
query("eval_script", "SELECT s_suppkey, round(s_acctbal * 2 + s_nationkey, 4) AS v FROM supplier", eval_script)
query("rank_within_group", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS r FROM orders QUALIFY r <= 3", lambda t: sorting.top_of_groups(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, "r").select("o_custkey", "o_orderkey", "r"))

# The catalog, files, snapshots and streams


def folder(t: Tables) -> str:
    """A new folder in shared storage."""
    return new_path(t.spark, "query")


NATIONS = "CREATE TABLE nations (n_nationkey INT, n_name TEXT, n_regionkey INT) WITH (segment_id_info='[n_regionkey]')"


def imported(t: Tables, form: str) -> DataFrame:
    from gneiss.plans.catalog import Catalog

    catalog, path = Catalog(t.spark), folder(t)
    catalog.create(NATIONS)
    write = t.nation.write.option("header", "true")
    {"parquet": write.parquet, "json": write.json, "csv": write.csv}[form](path)
    catalog.import_files("nations", path, form)
    return catalog.table("nations")


def resumed_index(t: Tables) -> DataFrame:
    """What the index of a table finds after a snapshot is loaded, with all cells probed."""
    from gneiss.plans.catalog import Catalog

    first, second, path = vector_table(t), Catalog(t.spark), folder(t)
    first.build_index("vectors", cells=8)
    first.save(path)
    second.load(path)
    return rounded(second.index("vectors").search(one(t), 10, ef=80), "vec_id", "label")


def snapshot(t: Tables) -> DataFrame:
    from gneiss.plans.catalog import Catalog

    first, second, path = Catalog(t.spark), Catalog(t.spark), folder(t)
    first.create(NATIONS)
    first.batch_insert("nations", t.nation)
    first.save(path)
    second.load(path)
    return second.scan("nations", "*", "n_regionkey < 3 AND n_name IS NOT NULL")


def described(t: Tables) -> DataFrame:
    from gneiss.plans.catalog import Catalog

    catalog = Catalog(t.spark)
    catalog.create(NATIONS)
    return catalog.describe("nations").select("position", "name", "type", "nullable", "is_segment")


def json_rows(t: Tables) -> DataFrame:
    from gneiss.plans.catalog import Catalog

    catalog = Catalog(t.spark)
    catalog.create(NATIONS)
    catalog.insert_json("nations", *(r[0] for r in t.nation.where("n_nationkey < 2").select(F.to_json(F.struct("*"))).collect()), '{"n_regionkey": 1, "n_name": "x", "n_nationkey": 99}')
    return catalog.table("nations")


def inserted(t: Tables) -> DataFrame:
    from gneiss.plans.catalog import Catalog

    catalog = Catalog(t.spark)
    catalog.create(NATIONS)
    return t.spark.createDataFrame([(catalog.batch_insert("nations", t.nation)["inserted_row_count"],)], "inserted long")


def dropped(t: Tables) -> DataFrame:
    """What another catalog over the same folder sees after a table is dropped."""
    from gneiss.plans.catalog import Catalog

    root = folder(t)
    first = Catalog(t.spark, root)
    first.create("CREATE TABLE a (id INT)")
    first.create(NATIONS)
    first.batch_insert("nations", t.nation)
    first.drop("nations")
    return Catalog(t.spark, root).list_tables()


def types_of(t: Tables) -> DataFrame:
    from gneiss.plans.catalog import Catalog

    catalog = Catalog(t.spark)
    catalog.create("CREATE TABLE kinds (a INT UNSIGNED, b ARRAY<ARRAY<INT>>, c ARRAY<FLOAT[3]>, d DECIMAL(12, 3), e ARRAY<VARCHAR(9)>, f TIMESTAMP, g BIGINT UNSIGNED, h FLOAT[4])")
    return catalog.describe("kinds").select("position", "name", "type", "declared")


def listed(t: Tables) -> DataFrame:
    from gneiss.plans.catalog import Catalog

    catalog = Catalog(t.spark)
    for name in ("b", "a", "gone"):
        catalog.create(f"CREATE TABLE {name} (id INT)")
    catalog.drop("gone")
    return catalog.list_tables()


def ddl_of(t: Tables) -> DataFrame:
    from gneiss.plans.catalog import Catalog

    return t.spark.createDataFrame([(Catalog(t.spark).ddl_of_parquet("nation", f"{t.sf_dir}/nation.parquet"),)], "ddl string")


def batch_of_table(t: Tables) -> DataFrame:
    return vector_table(t, "ipspace").batch_ann("vectors", 5, asking(t), projection="vec_id")


def streamed(t: Tables, rows: DataFrame, mode: str = "complete") -> DataFrame:
    """What a streaming query has written when it has taken all there is."""
    path = folder(t)
    query_ = rows.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return t.spark.read.parquet(f"{path}/out")


def stream_of(t: Tables, name: str) -> DataFrame:
    """A table's file as a stream of the files in the folder that have its name."""
    return t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


def group_read(t: Tables) -> DataFrame:
    """A log that two consumers of a group read by turns, with clicks acknowledged: what is pending."""
    from gneiss.streaming.groups import ConsumerGroup

    path, rows = folder(t), log(t).select("ms", "seq", "event_type")
    rows.where("seq % 2 = 0").write.parquet(f"{path}/log")
    group = ConsumerGroup(t.spark, f"{path}/log", rows.schema, f"{path}/group")
    group.read("a", now=1)
    rows.where("seq % 2 = 1").write.mode("append").parquet(f"{path}/log")
    group.read("b", now=2)
    group.ack(rows.where("event_type = 'click'"))
    return group.pending().select("ms", "seq", "consumer")


def from_json_text(t: Tables, text: str, name: str) -> DataFrame:
    """The rows of a result that was written as JSON."""
    import json

    rows_ = json.loads(text)[name]
    flat = [r for x in rows_ for r in (x if isinstance(x, list) else [x])]
    return t.spark.createDataFrame([tuple(r.values()) for r in flat], list(flat[0]))


def from_markdown(t: Tables, text: str) -> DataFrame:
    head, _, *body = ([c.strip() for c in line.strip("|").split("|")] for line in text.splitlines())
    return t.spark.createDataFrame(body, head)


def debugged(t: Tables) -> DataFrame:
    from gneiss.plans.catalog import Catalog

    catalog = Catalog(t.spark)
    catalog.create(NATIONS)
    catalog.batch_insert("nations", t.nation)
    return from_markdown(t, catalog.debug_scan("nations", "n_name, n_regionkey", "n_regionkey < 2"))


def refused(t: Tables) -> DataFrame:
    """Whether each of these is refused with an error of its own."""
    from gneiss.plans.catalog import Catalog, CatalogError
    from gneiss.plans.ddl import DdlError
    from gneiss.plans.filters import FilterError
    from gneiss.sources.rows import SchemaError

    catalog = Catalog(t.spark)
    catalog.create(NATIONS)
    tries = {
        "column against column": (FilterError, lambda: catalog.scan("nations", "*", "n_nationkey = n_regionkey")),
        "like without percent": (FilterError, lambda: catalog.scan("nations", "*", wire("n_name", "x", "like"))),
        "unknown column": (FilterError, lambda: catalog.scan("nations", "nope")),
        "columns of other types": (SchemaError, lambda: catalog.batch_insert("nations", t.nation.select("n_name", "n_name", "n_name"))),
        "too few columns": (SchemaError, lambda: catalog.batch_insert("nations", t.nation.select("n_nationkey"))),
        "a table twice": (CatalogError, lambda: catalog.create(NATIONS)),
        "no such table": (CatalogError, lambda: catalog.scan("none")),
        "unknown type": (DdlError, lambda: catalog.create("CREATE TABLE x (a JSON)")),
    }

    def fails(kind, run) -> bool:
        try:
            run()
        except kind:
            return True
        return False

    return t.spark.createDataFrame([(what, fails(*how)) for what, how in tries.items()], "what string, refused boolean")


def embedded(t: Tables) -> DataFrame:
    from gneiss.functions.registry import embedder

    return t.part.select("p_partkey", embedder(lambda texts: [[float(len(x)), float(x.count("e"))] for x in texts])(F.col("p_name")).alias("v")).select("p_partkey", F.col("v")[0].cast("double").alias("a"), F.col("v")[1].cast("double").alias("b"))


def batches(t: Tables) -> DataFrame:
    """Rows that are in memory as Arrow batches, scanned like a table."""
    return scan(from_ipc(t.spark, to_ipc(t.nation)), "n_name, n_regionkey", "n_regionkey > 2")


query("sink_ipc", "SELECT n_nationkey, n_name FROM nation", lambda t: from_ipc(t.spark, to_ipc(t.nation.select("n_nationkey", "n_name"))))
query("sink_json", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation", lambda t: from_json_text(t, to_json(t.nation.select("n_nationkey", "n_name")), "data"))
query("sink_json_batch", f"SELECT rank::BIGINT AS rank, vec_id, distance FROM ({batch_sql(L2)})", lambda t: from_json_text(t, batch_to_json(rounded(vectors.batch_ann(t.embeddings, asking(t), 5), "qid", "rank", "vec_id")), "data_list"))
query("sink_markdown", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation", lambda t: from_markdown(t, to_markdown(t.nation.select("n_nationkey", "n_name"))))
query("debug_scan", "SELECT n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation WHERE n_regionkey < 2", debugged)
query("batch_source", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey > 2", batches)
query("refused", "SELECT unnest(['column against column', 'like without percent', 'unknown column', 'columns of other types', 'too few columns', 'a table twice', 'no such table', 'unknown type']) AS what, true AS refused", refused)
query("text_embedding", "SELECT p_partkey, length(p_name)::DOUBLE AS a, (length(p_name) - length(replace(p_name, 'e', '')))::DOUBLE AS b FROM part", embedded)
query("filter_to_text", "SELECT '(a >= 3 OR NOT (b = 1 AND c LIKE ''x%''))' AS text, '((a < \"3\") AND (b Is null))' AS wire", lambda t: t.spark.createDataFrame([(str(parse_filter("a>=3 or not(b=1 and c like 'x%')")), parse_filter(wire("a", "3", ">=", "b", "isnotnull", "or", "not")).wire())], "text string, wire string"))
query("catalog_list", "SELECT * FROM (VALUES ('a'), ('b')) t(name)", listed)
query("catalog_describe", "SELECT * FROM (VALUES (0, 'n_nationkey', 'int', false, false), (1, 'n_name', 'string', false, false), (2, 'n_regionkey', 'int', false, true)) t(position, name, type, nullable, is_segment)", described)
query("catalog_ddl_of_parquet", "SELECT 'CREATE TABLE nation (n_nationkey INT, n_name TEXT, n_regionkey INT) WITH ( ... write metadata ... );' AS ddl", ddl_of)
for _form in ("parquet", "json", "csv"):
    query(f"import_{_form}", "SELECT * FROM nation", lambda t, form=_form: imported(t, form))
query("import_json_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 2 UNION ALL SELECT 99, 'x', 1", lambda t: json_rows(t))
query("insert_statistics", "SELECT count(*)::BIGINT AS inserted FROM nation", lambda t: inserted(t))
query("table_dropped", "SELECT 'a' AS name", lambda t: dropped(t))
query("ddl_types", "SELECT * FROM (VALUES (0, 'a', 'bigint', 'INT UNSIGNED'), (1, 'b', 'array<array<int>>', 'ARRAY<ARRAY<INT>>'), (2, 'c', 'array<array<float>>', 'ARRAY<FLOAT[3]>'), (3, 'd', 'decimal(12,3)', 'DECIMAL(12,3)'), (4, 'e', 'array<string>', 'ARRAY<VARCHAR>'), (5, 'f', 'timestamp_ntz', 'TIMESTAMP'), (6, 'g', 'decimal(20,0)', 'BIGINT UNSIGNED'), (7, 'h', 'array<float>', 'FLOAT[4]')) t(position, name, type, declared)", lambda t: types_of(t))
query("snapshot_index_resumed", nearest_sql(L2), resumed_index)
query("snapshot_load", "SELECT * FROM nation WHERE n_regionkey < 3", snapshot)
query("catalog_batch_ann", f"SELECT qid, rank, vec_id, distance FROM ({batch_sql(IP)})", lambda t: rounded(batch_of_table(t), "qid", "rank", "vec_id"))
query("stream_window_counts", "SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL", lambda t: streamed(t, windowed(stream_of(t, "events"), "ts", ["event_type"], "1 day", late="60 days")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"))
query("stream_hincrby", "SELECT user_id, event_type, count(*)::BIGINT AS value FROM events GROUP BY ALL", lambda t: streamed(t, counters.incr(stream_of(t, "events"), ["user_id", "event_type"])))
query("stream_group_pending", f"SELECT ms, seq, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'b' END AS consumer FROM {LOG} WHERE event_type <> 'click'", group_read)
query("xclaim", f"SELECT ms, seq, CASE WHEN user_id % 2 = 0 AND {FROM} - ms >= 86400000 THEN 'c9' ELSE 'c' || (user_id % 3) END AS consumer FROM {LOG} WHERE ms < {FROM} AND event_type <> 'click'", lambda t: logs.xclaim(pending(t), log(t).where("user_id % 2 = 0"), "c9", FROM, 86400000).select("ms", "seq", "consumer"))
query("keys_expire", "SELECT c_name AS key, (CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 3600 - 360000 WHEN c_custkey < 10 THEN 60 ELSE -1 END)::BIGINT AS ttl FROM customer", lambda t: keys.ttl(keys.expire(space(t), t.customer.where("c_custkey < 10").select(F.col("c_name").alias("key")), F.lit("2023-11-19 02:14:20").cast("timestamp"), only="nx"), "2023-11-19 02:13:20"))
query("set_union_store", "SELECT DISTINCT o_custkey AS member FROM orders WHERE o_orderstatus IN ('F', 'P')", lambda t: stored(t, sets.union(customers(t, "F"), customers(t, "P"))))


def stored(t: Tables, df: DataFrame) -> DataFrame:
    """The STORE forms: a result is written, and is a table like any other."""
    path = folder(t)
    df.write.parquet(path)
    return t.spark.read.parquet(path)
