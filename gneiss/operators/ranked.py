"""Ranked sets: DataFrames (member, score). Their order is (score, bytes of the member), so ranks have no ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.common import numbered
from gneiss.operators.sets import drawn

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}
#: The most ranks from an end that are found by a top-k; further ones by numbering all members.
TOP = 100_000


def no_nan(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(c)


def weighted(sets: list[DataFrame], weights: list[float] | None) -> DataFrame:
    """All members with weight * score and the number of their set; a set without scores has 1 for each; NaN is 0."""
    weights = [1.0] * len(sets) if weights is None else weights
    if len(weights) != len(sets):
        raise ValueError("there is a weight for each set")
    own = []
    for k, (s, w) in enumerate(zip(sets, weights, strict=True)):
        score = F.col("score").cast("double") if "score" in s.columns else F.lit(1.0)
        own.append(s.select("member", no_nan(score * F.lit(float(w))).alias("score"), F.lit(k).alias("_set")))
    return reduce(DataFrame.union, own)


def union(sets: list[DataFrame], weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    """ZUNION: each member with the sum, min or max of its weighted scores. Summed before the shuffle."""
    return weighted(sets, weights).groupBy("member").agg(no_nan(AGGREGATES[aggregate]("score")).alias("score"))


def inter(sets: list[DataFrame], weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    """ZINTER: the same for members of all sets, any number of them."""
    own = weighted(sets, weights).groupBy("member").agg(no_nan(AGGREGATES[aggregate]("score")).alias("score"), F.size(F.collect_set("_set")).alias("_in"))
    return own.where(F.col("_in") == len(sets)).select("member", "score")


def inter_card(sets: list[DataFrame], limit: int = 0) -> DataFrame:
    """ZINTERCARD: (n), up to limit if that is over 0."""
    own = inter(sets).select("member")
    return (own.limit(limit) if limit else own).agg(F.count("*").alias("n"))


def diff(first: DataFrame, *others: DataFrame) -> DataFrame:
    """ZDIFF: members of the first that no other has, with their score."""
    if not others:
        return first.select("member", "score")
    return first.join(reduce(DataFrame.union, (o.select("member") for o in others)).distinct(), "member", "left_anti").select("member", "score")


def order(reverse: bool = False) -> list[Column]:
    return [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]


def ranks(s: DataFrame, reverse: bool = False) -> DataFrame:
    """(member, score, rank from 0) of the whole set, without a task that holds all of it, whatever the scores."""
    own = s.select("member", F.col("score").cast("double").alias("score"))
    return numbered(own, order(reverse), "rank")


def by_rank(s: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """ZRANGE, ZREVRANGE: ranks start to stop, both inclusive, negative ones from the end: (member, score, rank)."""
    own = s.select("member", F.col("score").cast("double").alias("score"))
    if 0 <= stop < TOP and start >= 0:  # the best stop + 1 are enough
        own = own.orderBy(*order(reverse)).limit(stop + 1)
    size = own.count() if min(start, stop) < 0 else 0
    low, high = (max(0, size + x) if k == 0 and x < 0 else size + x if x < 0 else x for k, x in enumerate((start, stop)))
    return ranks(own, reverse).where(F.col("rank").between(low, high)).orderBy("rank")


def bound(column: str, text: str | float, low: bool) -> Column:
    """A score bound: a number, inf or -inf, exclusive with `(` before it."""
    text = str(text)
    exclusive, value = text.startswith("("), float(text.removeprefix("("))
    c = F.col(column).cast("double")
    if low:
        return c > value if exclusive else c >= value
    return c < value if exclusive else c <= value


def by_score(s: DataFrame, low: str | float, high: str | float, reverse: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """ZRANGEBYSCORE, ZREVRANGEBYSCORE."""
    out = s.where(bound("score", low, True) & bound("score", high, False)).select("member", "score").orderBy(*order(reverse))
    out = out.offset(offset) if offset else out
    return out if count is None or count < 0 else out.limit(count)


def lex_bound(text: str, low: bool) -> Column:
    """A bound by letters: `[x` inclusive, `(x` exclusive, `-` and `+` for no bound."""
    if text in ("-", "+"):
        return F.lit(text == ("-" if low else "+"))
    if text[:1] not in ("[", "("):
        raise ValueError("a bound by letters begins with [ or (")
    value, c = F.lit(text[1:]), F.col("member")
    if low:
        return c > value if text[0] == "(" else c >= value
    return c < value if text[0] == "(" else c <= value


def by_lex(s: DataFrame, low: str, high: str, reverse: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """ZRANGEBYLEX, ZREVRANGEBYLEX: by the bytes of the member."""
    out = s.where(lex_bound(low, True) & lex_bound(high, False)).select("member", "score").orderBy(F.desc("member") if reverse else F.asc("member"))
    out = out.offset(offset) if offset else out
    return out if count is None or count < 0 else out.limit(count)


def count(s: DataFrame, low: str | float, high: str | float) -> DataFrame:
    """ZCOUNT: (n)."""
    return s.where(bound("score", low, True) & bound("score", high, False)).agg(F.count("*").alias("n"))


def lex_count(s: DataFrame, low: str, high: str) -> DataFrame:
    """ZLEXCOUNT: (n)."""
    return s.where(lex_bound(low, True) & lex_bound(high, False)).agg(F.count("*").alias("n"))


def card(s: DataFrame) -> DataFrame:
    """ZCARD: (n)."""
    return s.agg(F.count("*").alias("n"))


def rank(s: DataFrame, asked: DataFrame, reverse: bool = False) -> DataFrame:
    """ZRANK, ZREVRANK: the asked members with rank and score, null if absent."""
    return asked.join(ranks(s, reverse), "member", "left").select("member", "rank", "score")


def score(s: DataFrame, asked: DataFrame) -> DataFrame:
    """ZSCORE, ZMSCORE: the asked members with their score, null if absent."""
    return asked.join(s.select("member", "score"), "member", "left")


def pop(s: DataFrame, n: int, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """ZPOPMIN, ZPOPMAX: (popped, left)."""
    popped = s.select("member", "score").orderBy(*order(highest)).limit(n)
    return popped, s.join(popped.select("member"), "member", "left_anti").select("member", "score")


def pop_first(sets: list[DataFrame], n: int = 1, highest: bool = False) -> tuple[int, DataFrame, DataFrame] | None:
    """ZMPOP, BZMPOP: (number of the first set that isn't empty, popped, left), or None."""
    for k, s in enumerate(sets):
        if not s.isEmpty():
            return k, *pop(s, n, highest)
    return None


def changes(s: DataFrame, more: DataFrame, only: str | None = None, bound: str | None = None, incr: bool = False) -> DataFrame:
    """(member, old, score): each member before and after ZADD, score null if it isn't in the set."""
    if only not in (None, "nx", "xx") or bound not in (None, "gt", "lt"):
        raise ValueError("only is nx or xx, bound is gt or lt")
    if only == "nx" and bound:
        raise ValueError("nx changes no score, so there is none to bound")
    old = s.select("member", F.col("score").cast("double").alias("score"), F.lit(0).alias("_new"))
    new = more.select("member", F.col("score").cast("double").alias("score"), F.lit(1).alias("_new"))
    both = old.union(new).groupBy("member").agg(F.max(F.when(F.col("_new") == 0, F.col("score"))).alias("old"), (F.sum if incr else F.max)(F.when(F.col("_new") == 1, F.col("score"))).alias("new"))
    to = F.col("old") + F.col("new") if incr else F.col("new")
    moves = F.col("new").isNotNull() & F.col("old").isNotNull()
    if only == "nx":
        moves = F.lit(False)
    elif bound is not None:
        moves = moves & (to > F.col("old") if bound == "gt" else to < F.col("old"))
    added = F.lit(None).cast("double") if only == "xx" else F.col("new")
    return both.select("member", "old", F.when(F.col("old").isNull(), added).when(moves, to).otherwise(F.col("old")).alias("score"))


def add(s: DataFrame, more: DataFrame, only: str | None = None, bound: str | None = None, incr: bool = False) -> DataFrame:
    """ZADD, ZINCRBY: s after the scores of more. only: nx (new members), xx (members there); bound: gt or lt, the new
    score replaces the old one if it is greater or less; incr adds it. Of several new scores of a member the greatest
    counts, or with incr their sum. One grouping by member."""
    return changes(s, more, only, bound, incr).where(F.col("score").isNotNull()).select("member", "score")


def add_count(s: DataFrame, more: DataFrame, only: str | None = None, bound: str | None = None, changed: bool = False) -> DataFrame:
    """What ZADD replies: (n), the members added, and with changed (CH) those with another score too."""
    own = changes(s, more, only, bound).where(F.col("score").isNotNull())
    counts = F.col("old").isNull() | (F.col("old") != F.col("score")) if changed else F.col("old").isNull()
    return own.agg(F.count(F.when(counts, 1)).alias("n"))


def remove(s: DataFrame, gone: DataFrame) -> DataFrame:
    """ZREM."""
    return s.join(gone.select("member").distinct(), "member", "left_anti").select("member", "score")


def remove_by_score(s: DataFrame, low: str | float, high: str | float) -> DataFrame:
    """ZREMRANGEBYSCORE: what is left."""
    return s.where(~(bound("score", low, True) & bound("score", high, False)))


def remove_by_lex(s: DataFrame, low: str, high: str) -> DataFrame:
    """ZREMRANGEBYLEX: what is left."""
    return s.where(~(lex_bound(low, True) & lex_bound(high, False)))


def remove_by_rank(s: DataFrame, start: int, stop: int) -> DataFrame:
    """ZREMRANGEBYRANK: what is left."""
    return s.join(by_rank(s, start, stop).select("member"), "member", "left_anti").select("member", "score")


def random_members(s: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """ZRANDMEMBER: n members in the order of a hash of the member and the seed; for n under 0 that many draws, repeats
    allowed."""
    if n < 0:
        return drawn(s.select("member", "score"), -n, seed)
    return s.select("member", "score").orderBy(F.xxhash64(F.lit(seed), "member"), "member").limit(n)
