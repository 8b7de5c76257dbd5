from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.streaming import logs
from gneiss.streaming.groups import ConsumerGroup, windowed

SCHEMA = T.StructType([T.StructField("ms", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("v", T.StringType())])


def test_ids(spark):
    log = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], SCHEMA)
    got = lambda df: [r["v"] for r in df.collect()]
    assert got(logs.xrange(log, "1-1", "+")) == ["b", "c"]
    assert got(logs.xrange(log, "(1-0", "1")) == ["b"]
    assert got(logs.xrange(log, count=2, reverse=True)) == ["c", "b"]
    assert got(logs.xread(log, "1-0")) == ["b", "c"]
    assert sorted(got(logs.xtrim(log, maxlen=2))) == ["b", "c"] and got(logs.xtrim(log, maxlen=0)) == []
    more = logs.xadd(log, spark.createDataFrame([("x",), ("y",)], "v string"), ["v"], F.lit(2).cast("long"))
    assert [(r["ms"], r["seq"]) for r in more.orderBy("ms", "seq").collect()] == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_claims(spark):
    log = spark.createDataFrame([(k, 0, "x") for k in range(1, 6)], SCHEMA)
    pending = logs.xack(logs.xreadgroup(log, "0-0", "a", now=100), log.where("ms = 2"))
    assert pending.count() == 4
    claimed = logs.xclaim(pending, log.where("ms <= 3"), "b", now=200, min_idle=50)
    assert {r["ms"]: (r["consumer"], r["times"]) for r in claimed.collect()} == {1: ("b", 2), 3: ("b", 2), 4: ("a", 1), 5: ("a", 1)}
    assert logs.xclaim(pending, log, "b", now=110, min_idle=50).where("consumer = 'b'").count() == 0
    assert logs.xpending(claimed).count() == 2


def test_consumer_group(spark, tmp_path):
    source, folder = f"{tmp_path}/log", f"{tmp_path}/group"
    spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], SCHEMA).write.parquet(source)
    group = ConsumerGroup(spark, source, SCHEMA, folder)
    assert group.read("c1", now=10) == 2
    spark.createDataFrame([(3, 0, "c")], SCHEMA).write.mode("append").parquet(source)
    again = ConsumerGroup(spark, source, SCHEMA, folder)
    assert again.read("c2", now=20) == 1 and again.read("c2", now=30) == 0
    group.ack(spark.createDataFrame([(1, 0)], "ms long, seq long"))
    assert sorted((r["ms"], r["consumer"]) for r in again.pending().collect()) == [(2, "c1"), (3, "c2")]
    assert {(r["consumer"], r["pending"]) for r in again.consumers().collect()} == {("c1", 1), ("c2", 1)}
    assert again.lag() == 0 and again.destroy() and again.lag() == 3


def test_windows_of_a_stream_are_those_of_the_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), "ts", ["event_type"], "1 day", late="60 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = lambda df: sorted((r["start"].replace(tzinfo=None), r["event_type"], r["n"]) for r in df.collect())
    assert rows(spark.table("windows")) == rows(windowed(events, "ts", ["event_type"], "1 day"))


def test_stores_and_blocking_pops(spark, tmp_path):
    import threading
    import time

    from gneiss.streaming.stores import Store, blocked, blpop, bzpopmin

    store = Store(spark, f"file://{tmp_path}/lists")
    assert store.versions() == []
    store.write(spark.createDataFrame([("a", ["1"]), ("b", ["2", "3"])], "key string, value array<string>"))
    assert blpop(store, ["none", "b", "a"], 1, n=5, from_left=False) == ("b", ["3", "2"]) and blpop(store, ["a"], 1) == ("a", ["1"])
    began = time.monotonic()
    assert blpop(store, ["a", "b"], 0.3) is None and time.monotonic() - began < 20
    later = threading.Timer(0.5, lambda: store.write(spark.createDataFrame([("a", ["9"])], "key string, value array<string>")))
    later.start()
    assert blpop(store, ["a"], 60) == ("a", ["9"])
    later.join()
    (tmp_path / "lists" / "version-99").mkdir()
    assert store.versions()[-1] < 99 and store.read().count() == 0
    sets = Store(spark, f"file://{tmp_path}/sets")
    sets.write(spark.createDataFrame([("z", "m", 1.0), ("z", "n", 2.0), ("y", "m", 0.0)], "key string, member string, score double"))
    name, popped = bzpopmin(sets, ["x", "z"], 1, n=1, highest=True)
    assert name == "z" and [r["member"] for r in popped.collect()] == ["n"]
    assert sorted((r["key"], r["member"]) for r in sets.read().collect()) == [("y", "m"), ("z", "m")]
    assert blocked(lambda: None, 0.05, 0.02) is None


def test_group_of_a_table(spark):
    log = spark.createDataFrame([(k, 0, "x") for k in range(1, 6)], SCHEMA)
    group = logs.Group.create(log, "0")
    entries, group = group.read(log, "a", 1, count=2)
    assert [r["ms"] for r in entries.collect()] == [1, 2] and group.last == (2, 0)
    again, same_group = group.ack(log.where("ms = 1")).read(log, "a", 2, after="0")
    assert [r["ms"] for r in again.collect()] == [2] and same_group.last == (2, 0)
    assert group.read(log, "b", 3, noack=True)[1].pending.count() == 2
    assert group.create_consumer("a", 9) is group
    assert logs.Group.create(log.limit(0)).read(log.limit(0), "a", 1)[0].count() == 0
    for bad in ("4-0", "0-0"):
        with __import__("pytest").raises(ValueError):
            logs.xsetid(log, bad)
    assert logs.last_id(log.limit(0)) == (0, 0)
