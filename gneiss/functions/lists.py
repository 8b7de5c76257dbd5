"""Lists as array columns, hashes as map columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.operators.sets import matches


def clamped(at: int, n: Column) -> Column:
    """A position from 0; a negative one counts from the end and is 0 at least."""
    return F.lit(at) if at >= 0 else F.greatest(n + at, F.lit(0))


def lindex(c: Column, at: int) -> Column:
    """LINDEX: null beyond either end."""
    return F.get(c, F.lit(at) if at >= 0 else F.size(c) + at)


def lrange(c: Column, start: int, stop: int) -> Column:
    """LRANGE, LTRIM: start to stop, inclusive, negative ones from the end."""
    n = F.size(c)
    low, high = clamped(start, n), F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return F.slice(c, low + 1, F.greatest(high - low + 1, F.lit(0)))


ltrim = lrange


def lpos(c: Column, value, rank: int = 1, count: int | None = None, maxlen: int = 0) -> Column:
    """LPOS: the place of the rank-th match, from the end for a negative rank; with count that many places, 0 for all.
    maxlen is how many items are compared, 0 for all."""
    if rank == 0:
        raise ValueError("rank is not 0")
    n = F.size(c)
    places = F.filter(F.transform(c, lambda x, i: F.when(x == F.lit(value), i)), lambda i: i.isNotNull())
    if rank < 0:
        places = F.reverse(places)
    if maxlen:
        places = F.filter(places, lambda i: i < maxlen) if rank > 0 else F.filter(places, lambda i: i >= n - maxlen)
    if count is None:
        return F.get(places, F.lit(abs(rank) - 1))
    rest = F.slice(places, abs(rank), F.greatest(F.size(places), F.lit(1)))
    return rest if count == 0 else F.slice(rest, 1, count)


def linsert(c: Column, pivot, value, before: bool = True) -> Column:
    """LINSERT at the first pivot; unchanged without one."""
    at = F.array_position(c, F.lit(pivot)).cast("int")
    to = at if before else at + 1
    return F.when(at > 0, F.concat(F.slice(c, 1, F.greatest(to - 1, F.lit(0))), F.array(F.lit(value)), F.slice(c, F.greatest(to, F.lit(1)), F.size(c) + 1))).otherwise(c)


def lset(c: Column, at: int, value) -> Column:
    """LSET; a place beyond either end is an error."""
    n = F.size(c)
    place = F.lit(at) if at >= 0 else n + at
    changed = F.transform(c, lambda x, i: F.when(i == place, F.lit(value)).otherwise(x))
    return F.when((place >= 0) & (place < n), changed).otherwise(F.raise_error(F.lit("index out of range")).cast("array<string>"))


def lrem(c: Column, count: int, value) -> Column:
    """LREM: the first count equal items go, the last ones for a negative count, all for 0."""
    if count == 0:
        return F.filter(c, lambda x: ~x.eqNullSafe(F.lit(value)))
    own = c if count > 0 else F.reverse(c)
    start = F.struct(F.slice(own, 1, 0).alias("kept"), F.lit(0).alias("gone"))
    step = lambda acc, x: F.when((x == F.lit(value)) & (acc["gone"] < abs(count)), F.struct(acc["kept"].alias("kept"), (acc["gone"] + 1).alias("gone"))).otherwise(F.struct(F.array_append(acc["kept"], x).alias("kept"), acc["gone"].alias("gone")))
    kept = F.aggregate(own, start, step, lambda acc: acc["kept"])
    return kept if count > 0 else F.reverse(kept)


def lpush(c: Column, *values) -> Column:
    """LPUSH: each value in front of what is there."""
    return F.concat(F.array(*(F.lit(v) for v in reversed(values))), F.coalesce(c, F.array().cast("array<string>")))


def rpush(c: Column, *values) -> Column:
    """RPUSH."""
    return F.concat(F.coalesce(c, F.array().cast("array<string>")), F.array(*(F.lit(v) for v in values)))


def lpop(c: Column, n: int = 1) -> tuple[Column, Column]:
    """LPOP: (popped, left)."""
    return F.slice(c, 1, n), F.slice(c, n + 1, F.size(c) + 1)


def rpop(c: Column, n: int = 1) -> tuple[Column, Column]:
    """RPOP: (popped, left), the last one first."""
    keep = F.greatest(F.size(c) - n, F.lit(0))
    return F.reverse(F.slice(c, keep + 1, n)), F.slice(c, 1, keep)


def lmove(source: Column, to: Column, from_left: bool = True, to_left: bool = True) -> tuple[Column, Column]:
    """LMOVE, RPOPLPUSH: both lists after an item's move."""
    popped, left = lpop(source) if from_left else rpop(source)
    return left, F.concat(popped, to) if to_left else F.concat(to, popped)


def hset(c: Column, **fields: str) -> Column:
    """HSET, HMSET: new values replace old ones."""
    new = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))
    return F.map_concat(F.map_filter(c, lambda k, v: ~k.isin(*fields)), new)


def hsetnx(c: Column, field: str, value: str) -> Column:
    """HSETNX: only a field that is not there."""
    return F.when(F.map_contains_key(c, field), c).otherwise(F.map_concat(c, F.create_map(F.lit(field), F.lit(value))))


def hget(c: Column, field: str) -> Column:
    """HGET: null if missing."""
    return F.try_element_at(c, F.lit(field))


def hmget(c: Column, *fields: str) -> Column:
    """HMGET."""
    return F.array(*(hget(c, f) for f in fields))


def hexists(c: Column, field: str) -> Column:
    """HEXISTS."""
    return F.map_contains_key(c, field)


def hdel(c: Column, *fields: str) -> Column:
    """HDEL."""
    return F.map_filter(c, lambda k, v: ~k.isin(*fields))


def hkeys(c: Column) -> Column:
    """HKEYS, sorted."""
    return F.array_sort(F.map_keys(c))


def hvals(c: Column) -> Column:
    """HVALS, in the order of the sorted fields."""
    return F.transform(hkeys(c), lambda k: F.try_element_at(c, k))


def hgetall(c: Column) -> Column:
    """HGETALL: sorted structs (key, value)."""
    return F.array_sort(F.map_entries(c))


def hlen(c: Column) -> Column:
    """HLEN."""
    return F.size(c)


def hstrlen(c: Column, field: str) -> Column:
    """HSTRLEN: bytes of the value, 0 if missing."""
    return F.coalesce(F.octet_length(hget(c, field)), F.lit(0))


def hincrby(c: Column, field: str, by: int) -> Column:
    """HINCRBY of one map; a missing field is 0."""
    to = (F.coalesce(hget(c, field).cast("long"), F.lit(0)) + by).cast("string")
    return F.map_concat(hdel(c, field), F.create_map(F.lit(field), to))


def hrandfield(c: Column, n: int = 1, seed: int = 0) -> Column:
    """HRANDFIELD: n fields in the order of a hash of the field and the seed."""
    mixed = F.array_sort(F.transform(F.map_keys(c), lambda k: F.struct(F.xxhash64(F.lit(seed), k), k.alias("k"))))
    return F.transform(F.slice(mixed, 1, n), lambda x: x["k"])


def hscan(c: Column, pattern: str = "*") -> Column:
    """HSCAN MATCH: sorted structs (key, value) of the fields that a pattern fits."""
    return F.filter(hgetall(c), lambda x: matches(x["key"], pattern))


def lmpop(columns: list[Column], n: int = 1, from_left: bool = True) -> tuple[Column, Column, list[Column]]:
    """LMPOP: (number of the first list that isn't empty, or null; popped; all lists after)."""
    filled = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in columns]
    first = F.lit(None).cast("int")
    popped = F.lit(None)
    for k in reversed(range(len(columns))):
        first = F.when(filled[k], k).otherwise(first)
        popped = F.when(filled[k], (lpop if from_left else rpop)(columns[k], n)[0]).otherwise(popped)
    left = [F.when(first.eqNullSafe(F.lit(k)), (lpop if from_left else rpop)(c, n)[1]).otherwise(c) for k, c in enumerate(columns)]
    return first, popped, left
