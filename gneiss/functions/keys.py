"""Key spaces: DataFrames (key, type, value[, expires_at]); each change gives a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.sets import matches


def scan(space: DataFrame, pattern: str = "*", kind: str | None = None) -> DataFrame:
    """KEYS, SCAN MATCH TYPE: the keys that a pattern fits. A pattern with a plain start is a prefix filter as well,
    which reaches the files."""
    out = space
    start = pattern[: next((k for k, c in enumerate(pattern) if c in "*?[\\"), len(pattern))]
    if start:
        out = out.where(F.col("key").startswith(start))
    out = out.where(matches("key", pattern))
    return (out.where(F.col("type") == kind) if kind else out).select("key").distinct()


def live(space: DataFrame, now: str | Column) -> DataFrame:
    """Rows that have not expired at an instant."""
    return space.where(F.col("expires_at").isNull() | (F.col("expires_at") > (F.lit(now).cast("timestamp") if isinstance(now, str) else now)))


def expire(space: DataFrame, keys: DataFrame, at: Column, only: str | None = None) -> DataFrame:
    """EXPIRE, EXPIREAT: keys get an instant; nx: if they have none, xx: if they have one, gt or lt: if later or earlier
    than theirs, none being the latest."""
    old = F.col("expires_at")
    ok = {None: F.lit(True), "nx": old.isNull(), "xx": old.isNotNull(), "gt": old.isNotNull() & (at > old), "lt": old.isNull() | (at < old)}[only]
    marked = space.join(keys.select("key").distinct().withColumn("_asked", F.lit(True)), "key", "left")
    return marked.withColumn("expires_at", F.when(F.col("_asked") & ok, at).otherwise(old)).drop("_asked").select(space.columns)


def persist(space: DataFrame, keys: DataFrame) -> DataFrame:
    """PERSIST."""
    marked = space.join(keys.select("key").distinct().withColumn("_asked", F.lit(True)), "key", "left")
    return marked.withColumn("expires_at", F.when(F.col("_asked").isNull(), F.col("expires_at"))).drop("_asked").select(space.columns)


def ttl(space: DataFrame, now: str, asked: DataFrame | None = None, milliseconds: bool = False) -> DataFrame:
    """TTL, PTTL: (key, ttl) in seconds or milliseconds, -1 for keys that never expire; of the asked keys only, -2 for
    those that are missing."""
    left = F.col("expires_at").cast("timestamp").cast("double") - F.lit(now).cast("timestamp").cast("double")
    left = F.round(left * 1000 if milliseconds else left).cast("long")
    own = space.select("key", F.when(F.col("expires_at").isNull(), F.lit(-1)).otherwise(left).cast("long").alias("ttl")).distinct()
    if asked is None:
        return own
    return asked.select("key").join(own, "key", "left").select("key", F.coalesce("ttl", F.lit(-2)).cast("long").alias("ttl"))


def exists(space: DataFrame, asked: DataFrame) -> DataFrame:
    """EXISTS, TOUCH, TYPE: the asked keys with their type, null if missing."""
    return asked.join(space.select("key", "type").distinct(), "key", "left")


def delete(space: DataFrame, keys: DataFrame) -> DataFrame:
    """DEL, UNLINK."""
    return space.join(keys.select("key").distinct(), "key", "left_anti").select(space.columns)


def has(space: DataFrame, key: str) -> bool:
    return not space.where(F.col("key") == key).isEmpty()


def rename(space: DataFrame, old: str, new: str, only_free: bool = False) -> DataFrame:
    """RENAME, RENAMENX: what was under the new key goes, unless only_free, which then changes nothing. A key that is
    missing can't be renamed; one renamed to itself stays."""
    if not has(space, old):
        raise KeyError(f"no key {old}")
    if old == new or only_free and has(space, new):
        return space
    return space.where(F.col("key") != new).withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


def copy(space: DataFrame, old: str, new: str, replace: bool = False) -> DataFrame:
    """COPY: a new key gets the rows of the old one. A missing old key, or without replace a taken new one, changes
    nothing."""
    if old == new:
        raise ValueError("a key is not copied to itself")
    if not has(space, old) or not replace and has(space, new):
        return space
    kept = space.where(F.col("key") != new)
    return kept.union(space.where(F.col("key") == old).withColumn("key", F.lit(new)).select(space.columns))


def put(space: DataFrame, new: DataFrame, only: str | None = None, expires_at: Column | None = None, keep_ttl: bool = False) -> DataFrame:
    """SET, MSET, SETNX: the space after the new rows (key, value). only: nx (missing keys) or xx (keys there).

    A key that is set is a string, whatever it was, and expires at expires_at, or as before with keep_ttl, or never. Of
    several new values of a key the greatest counts. One grouping by key.
    """
    extra = [c for c in space.columns if c not in ("key", "value")]
    given = {"type": F.lit("string"), "expires_at": F.lit(None) if expires_at is None else expires_at}
    fresh = new.select("key", "value", *(given.get(c, F.lit(None)).cast(space.schema[c].dataType).alias(c) for c in extra))
    both = space.select("key", "value", *extra, F.lit(False).alias("_new")).union(fresh.withColumn("_new", F.lit(True)))
    row = F.struct("value", *extra)
    both = both.groupBy("key").agg(F.max(F.when(~F.col("_new"), row)).alias("old"), F.max(F.when(F.col("_new"), row)).alias("new"))
    there, asked = F.col("old").isNotNull(), F.col("new").isNotNull()
    sets = asked & {None: F.lit(True), "nx": ~there, "xx": there}[only]
    both = both.where(there | sets)
    pick = lambda c: F.when(sets, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    out = {c: pick(c) for c in ("value", *extra)}
    if keep_ttl and "expires_at" in extra:
        out["expires_at"] = F.when(there, F.col("old.expires_at")).otherwise(F.col("new.expires_at"))
    return both.select(*(F.col("key") if c == "key" else out[c].alias(c) for c in space.columns))


def put_all_if_free(space: DataFrame, new: DataFrame) -> DataFrame:
    """MSETNX: all new rows, or none if one of their keys is there."""
    return put(space, new) if space.join(new.select("key"), "key", "left_semi").isEmpty() else space


def get(space: DataFrame, asked: DataFrame) -> DataFrame:
    """GET, MGET: the asked keys with their value, null if missing."""
    return asked.join(space.groupBy("key").agg(F.min("value").alias("value")), "key", "left")


def get_and_put(space: DataFrame, new: DataFrame, only: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """GETSET, SET ... GET: (the old values of the keys, the space after)."""
    return get(space, new.select("key")), put(space, new, only, **how)


def get_and_expire(space: DataFrame, asked: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """GETEX: (values, the space with the keys expiring at an instant, or with none never)."""
    return get(space, asked), expire(space, asked, at) if at is not None else persist(space, asked)


def get_and_delete(space: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GETDEL: (values, the space without the keys)."""
    return get(space, asked), delete(space, asked)


def random_key(space: DataFrame, seed: int = 0) -> DataFrame:
    """RANDOMKEY."""
    return space.select("key").distinct().orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(1)
