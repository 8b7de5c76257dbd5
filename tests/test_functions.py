import itertools
import random

import pytest
from pyspark.sql import functions as F

from gneiss.functions import geo, keys, lists, strings
from gneiss.functions.registry import Functions, evaluate
from gneiss.operators import ranked, sets


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, (list, dict)) else F.expr(v["sql"]).alias(k) if isinstance(v, dict) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        common = strings.lcs_of(a, b)
        assert len(common) == lcs_length(a, b)
        for s in (a, b):
            rest = iter(s)
            assert all(c in rest for c in common)
        for i, k, j, m, n in strings.matches_of(a, b):
            assert a[i : k + 1] == b[j : m + 1] and k - i + 1 == n
        assert sum(m[4] for m in strings.matches_of(a, b)) == len(common)
    assert strings.matches_of("ohmytext", "mynewtext", 4) == [(4, 7, 5, 8, 4)]


@pytest.mark.parametrize("start, end, wanted", [(0, 3, "This"), (-3, -1, "ing"), (0, -1, "This is a string"), (10, 100, "string"), (-1, -5, ""), (5, 3, ""), (-100, 1, "Th")])
def test_getrange(spark, start, end, wanted):
    assert one(spark, strings.getrange(F.col("s"), start, end), s="This is a string") == wanted


def test_strings(spark):
    assert one(spark, strings.setrange(F.col("s"), 6, "Spark"), s="Hello World") == "Hello Spark"
    assert one(spark, strings.setrange(F.col("s"), 4, "x"), s="ab") == "ab\0\0x"
    assert one(spark, strings.append(F.lit(None).cast("string"), "x"), s="") == "x"
    assert one(spark, strings.bitcount(F.col("s")), s="foobar") == 26
    assert one(spark, strings.bitpos(F.unhex(F.lit("FFF000")), 0), s="") == 12
    assert one(spark, strings.bitpos(F.unhex(F.lit("FFFF")), 0), s="") == 16
    assert one(spark, strings.bitpos(F.unhex(F.lit("0000")), 1), s="") == -1
    assert one(spark, F.hex(strings.setbit(F.unhex(F.lit("")), 7, 1)), s="") == "01"
    assert one(spark, F.hex(strings.setbit(F.unhex(F.lit("FF")), 17, 1)), s="") == "FF0040"
    assert one(spark, strings.getbit(F.unhex(F.lit("01")), 7), s="") == 1
    assert one(spark, strings.getbit(F.unhex(F.lit("01")), 70), s="") == 0


@pytest.mark.parametrize("kwargs, wanted", [({}, 2), ({"rank": 2}, 6), ({"rank": -1}, 7), ({"count": 2}, [2, 6]), ({"rank": -1, "count": 2}, [7, 6]), ({"count": 0, "maxlen": 7}, [2, 6]), ({"rank": 9}, None)])
def test_lpos(spark, kwargs, wanted):
    assert one(spark, lists.lpos(F.col("a"), "c", **kwargs), a=["a", "b", "c", "1", "2", "3", "c", "c"]) == wanted


def test_lists(spark):
    run = lambda c: one(spark, c, a=["a", "b", "a", "c", "a"])
    a = F.col("a")
    assert run(lists.lrem(a, 2, "a")) == ["b", "c", "a"]
    assert run(lists.lrem(a, -2, "a")) == ["a", "b", "c"]
    assert run(lists.lrem(a, 0, "a")) == ["b", "c"]
    assert run(lists.linsert(a, "b", "x", before=False)) == ["a", "b", "x", "a", "c", "a"]
    assert run(lists.linsert(a, "none", "x")) == ["a", "b", "a", "c", "a"]
    assert run(lists.lrange(a, -100, 1)) == ["a", "b"] and run(lists.lrange(a, 9, 10)) == []
    assert run(lists.rpop(a, 2)[0]) == ["a", "c"] and run(lists.lpop(a, 2)[1]) == ["a", "c", "a"]
    with pytest.raises(Exception, match="out of range"):
        run(lists.lset(a, 9, "x"))
    with pytest.raises(ValueError):
        lists.lpos(a, "a", rank=0)


def test_hashes(spark):
    h = F.create_map(F.lit("a"), F.lit("1"))
    assert one(spark, lists.hincrby(h, "b", 4), s="") == {"a": "1", "b": "4"}
    assert one(spark, lists.hsetnx(h, "a", "9"), s="") == {"a": "1"}
    assert one(spark, lists.hmget(h, "a", "x"), s="") == ["1", None]
    assert one(spark, lists.hstrlen(h, "x"), s="") == 0
    assert one(spark, lists.hrandfield(h, 3), s="") == ["a"]


def plain_geohash(lon, lat, lat_limit, steps):
    bits, box = 0, [[-180.0, 180.0], [-lat_limit, lat_limit]]
    for k in range(2 * steps):
        own = box[k % 2]
        middle = sum(own) / 2
        up = (lon, lat)[k % 2] >= middle
        own[0 if up else 1] = middle
        bits = bits << 1 | up
    return bits, box


def test_geohash(spark):
    rng = random.Random(2)
    places = [(13.361389, 38.115556), (15.087269, 37.502669), (0.0, 0.0), *((rng.uniform(-180, 180), rng.uniform(-85, 85)) for _ in range(50))]
    df = spark.createDataFrame(places, "lon double, lat double")
    out = df.withColumn("bits", geo.geohash_bits(F.col("lon"), F.col("lat"))).withColumn("p", geo.position(F.col("bits"))).withColumn("text", geo.geohash(F.col("bits"))).collect()
    for r in out:
        bits, box = plain_geohash(r["lon"], r["lat"], 85.05112878, 26)
        assert r["bits"] == bits
        assert abs(r["p"]["lon"] - sum(box[0]) / 2) < 1e-9 and abs(r["p"]["lat"] - sum(box[1]) / 2) < 1e-9
        letters = plain_geohash(r["p"]["lon"], r["p"]["lat"], 90, 26)[0]
        assert r["text"][:10] == "".join(geo.BASE32[letters >> (52 - 5 * (k + 1)) & 31] for k in range(10))
    assert out[0]["bits"] == 3479099956230698 and out[0]["text"] == "sqc8b49rny0" and out[1]["text"] == "sqdtr74hyu0"
    d = df.limit(1).select(geo.distance(F.lit(13.361389), F.lit(38.115556), F.lit(15.087269), F.lit(37.502669)).alias("d")).first()["d"]
    assert abs(d - 166274.1516) < 0.5


def test_glob(spark):
    df = spark.createDataFrame([(x,) for x in ("hello", "hallo", "hxllo", "hllo", "h*llo", "heello")], "member string")
    got = lambda p: sorted(r[0] for r in df.where(sets.matches("member", p)).collect())
    assert got("h?llo") == ["h*llo", "hallo", "hello", "hxllo"]
    assert got("h[ae]llo") == ["hallo", "hello"]
    assert got("h[^e]llo") == ["h*llo", "hallo", "hxllo"]
    assert got("h[a-b]llo") == ["hallo"]
    assert got("h\\*llo") == ["h*llo"]
    assert got("h*llo") == sorted(["hello", "hallo", "hxllo", "hllo", "h*llo", "heello"])


def test_ranked_corner_cases(spark):
    z = lambda *rows: spark.createDataFrame(list(rows), "member string, score double")
    inf = float("inf")
    out = {r["member"]: r["score"] for r in ranked.union([z(("a", inf), ("b", 1.0)), z(("a", -inf))]).collect()}
    assert out == {"a": 0.0, "b": 1.0}
    plain = spark.createDataFrame([("a",), ("c",)], "member string")
    assert {r["member"]: r["score"] for r in ranked.inter([z(("a", 5.0), ("b", 1.0)), plain], [2, 3]).collect()} == {"a": 13.0}
    s = z(("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", 3.0))
    got = lambda df: [r["member"] for r in df.collect()]
    assert sorted(got(ranked.by_rank(s, -2, -1))) == ["c", "d"] and got(ranked.by_rank(s, 0, -1).orderBy("rank")) == ["a", "b", "c", "d"]
    assert got(ranked.by_rank(s, 5, 9)) == [] and got(ranked.by_score(s, "(1", "+inf")) == ["c", "d"]
    assert got(ranked.by_lex(s, "-", "(c")) == ["a", "b"]
    assert got(ranked.pop(s, 1)[0]) == ["a"] and got(ranked.pop(s, 1, highest=True)[0]) == ["d"]
    assert {r["member"]: r["score"] for r in ranked.add(s, z(("a", 0.5), ("e", 9.0)), only="xx", bound="lt").collect()}["a"] == 0.5
    assert sorted(got(sets.random_members(s.select("member"), 2, seed=1))) == sorted(got(sets.random_members(s.select("member"), 2, seed=1)))
    assert sets.random_members(s.select("member"), -9).count() == 9
    assert ranked.ranks(s.limit(0)).count() == 0


def test_key_spaces(spark):
    space = spark.createDataFrame([("a", "string", "1", None), ("b", "hash", "2", None)], "key string, type string, value string, expires_at timestamp")
    a = spark.createDataFrame([("a",)], "key string")
    at = F.lit("2024-01-01 00:00:10").cast("timestamp")
    dated = keys.expire(space, a, at)
    assert {r["key"]: r["ttl"] for r in keys.ttl(dated, "2024-01-01 00:00:00").collect()} == {"a": 10, "b": -1}
    assert keys.live(dated, "2024-01-01 00:00:10").count() == 1 and keys.live(keys.persist(dated, a), "2025-01-01").count() == 2
    assert keys.expire(space, a, at, only="xx").where("expires_at IS NOT NULL").isEmpty()
    assert sorted(r["key"] for r in keys.copy(space, "a", "c").collect()) == ["a", "b", "c"]
    assert sorted(r["key"] for r in keys.rename(space, "a", "b").collect()) == ["b"]
    assert keys.rename(space, "a", "b", only_free=True).count() == 2
    assert {r["key"]: r["type"] for r in keys.exists(space, a).collect()} == {"a": "string"}


def test_key_spaces_corner_cases(spark):
    space = spark.createDataFrame([("a", "string", "1", None), ("b", "hash", "2", None)], "key string, type string, value string, expires_at timestamp")
    got = lambda df: sorted((r["key"], r["value"]) for r in df.collect())
    with pytest.raises(KeyError):
        keys.rename(space, "none", "b")
    assert got(keys.rename(space, "a", "a")) == got(space) == got(keys.copy(space, "none", "c")) == got(keys.copy(space, "a", "b"))
    assert got(keys.copy(space, "a", "b", replace=True)) == [("a", "1"), ("b", "1")]
    plain = space.select("key", "value")
    assert got(keys.put(plain, spark.createDataFrame([("a", "7"), ("a", "8"), ("c", None)], "key string, value string"))) == [("a", "8"), ("b", "2"), ("c", None)]
    assert got(keys.put(plain, plain.limit(0))) == got(plain)
    twice = space.union(space.where("key = 'b'"))
    assert got(keys.get(twice, space.select("key"))) == [("a", "1"), ("b", "2")]


def test_ranks_whatever_the_number_of_partitions(spark):
    rows = [(f"m{k:04}", float(k * 7919 % 50)) for k in range(700)] + [("nan", None)]
    s = spark.createDataFrame(rows, "member string, score double")
    want = {m: k for k, (m, _) in enumerate(sorted(rows, key=lambda r: (-1e9 if r[1] is None else r[1], r[0])))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "500", "4000"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = ranked.ranks(s)
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            assert {r["member"]: r["rank"] for r in out.collect()} == want
        back = {r["member"]: r["rank"] for r in ranked.ranks(s, reverse=True).collect()}
        assert back == {m: 700 - k for m, k in want.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        ranked.add(s, s, only="nx", bound="gt")


def test_byte_strings(spark):
    assert one(spark, F.hex(strings.getrange(F.col("s"), 0, 1)), s="h\u00e9llo") == "68C3"
    assert one(spark, F.hex(strings.setrange(F.col("s"), 2, "x")), s="h\u00e9llo") == "68C3786C6C6F"
    assert one(spark, F.hex(strings.setrange(F.lit(None).cast("string"), 2, "x")), s="") == "000078"
    assert one(spark, F.hex(strings.bitop("and", F.col("s"), F.lit("ab"))), s="a") == "6100"
    assert one(spark, F.hex(strings.bitop("or", F.col("s"), F.lit(None).cast("string"))), s="a") == "61"
    assert one(spark, strings.field_get(F.unhex(F.lit("FFFFFFFFFFFFFFFF")), "i64", 0), s="") == -1
    assert one(spark, strings.field_get(F.unhex(F.lit("FFFFFFFFFFFFFFFF")), "u63", 0), s="") == 2**63 - 1
    assert one(spark, strings.field_get(F.unhex(F.lit("80")), "i8", 4), s="") == 0
    assert one(spark, strings.field_get(F.unhex(F.lit("08")), "i8", 4), s="") == -128
    assert one(spark, F.hex(strings.field_set(F.col("s"), "i16", 8, -2)), s="a") == "61FFFE"
    changed, value = strings.field_incr(F.unhex(F.lit("FF")), "u8", 0, 2, "wrap")
    assert one(spark, F.concat_ws(" ", F.hex(changed), value.cast("string")), s="") == "01 1"
    assert one(spark, strings.field_incr(F.unhex(F.lit("7FFFFFFFFFFFFFFF")), "i64", 0, 1, "sat")[1], s="") == 2**63 - 1
    assert one(spark, strings.bitpos(F.unhex(F.lit("FFF000")), 1, 2), s="") == -1 and one(spark, strings.bitpos(F.unhex(F.lit("FF")), 0, 0, -1), s="") == -1
    assert one(spark, strings.bitcount(F.col("s"), 1, 1), s="foobar") == 6 and one(spark, strings.bitcount(F.col("s"), 5, 30, "bit"), s="foobar") == 17
    with pytest.raises(ValueError):
        strings.field_get(F.col("s"), "u64", 0)
    assert one(spark, strings.tokens(F.col("s"), "."), s=".a..b") == ["a", "b"] and one(spark, strings.token(F.col("s"), ".", 9), s=".a") == ""


def test_scripts(spark):
    from gneiss.functions.registry import Scripts

    scripts = Scripts()
    digest = scripts.load("a + 1")
    assert scripts.exists(digest, "0") == [True, False]
    assert [r[0] for r in spark.range(2).select(scripts.run(digest, "long", a=F.col("id"))).collect()] == [1, 2]
    scripts.flush()
    with pytest.raises(KeyError):
        scripts.run(digest, "long", a=F.col("id"))


def test_functions(spark):
    lib = Functions(spark)
    lib.load("mine", {"double_it": (lambda x: x * 2, "long")})
    assert [r[0] for r in spark.range(3).select(lib.call("double_it", F.col("id"))).collect()] == [0, 2, 4]
    assert spark.sql("SELECT double_it(4)").first()[0] == 8
    with pytest.raises(KeyError):
        lib.load("other", {"double_it": (lambda x: x, "long")})
    saved = lib.dump()
    lib.delete("mine")
    with pytest.raises(KeyError):
        lib.call("double_it", F.col("id"))
    lib.restore(saved)
    assert lib.list().count() == 1
    assert spark.range(2).select(evaluate(lambda x: x + 1, "long", F.col("id")).alias("x")).agg(F.sum("x")).first()[0] == 3
