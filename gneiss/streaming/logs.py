"""Append logs as tables: rows with an ID of two parts, ms and seq, and consumer groups kept as tables beside them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.common import look_up, numbered, staged

ID = ["ms", "seq"]


def bound(text: str | int | tuple, low: bool) -> tuple[int, int, bool]:
    """(ms, seq, exclusive) of `-`, `+`, `ms`, `ms-seq`, `(ms-seq`, a number or a pair."""
    if isinstance(text, tuple):
        return text[0], text[1], False
    text = str(text)
    if text in ("-", "+"):
        return (0, 0, False) if text == "-" else (2**63 - 1, 2**63 - 1, False)
    exclusive = text.startswith("(")
    ms, _, seq = text.removeprefix("(").partition("-")
    return int(ms), int(seq) if seq else (0 if low else 2**63 - 1), exclusive


def at_least(ms: int, seq: int, exclusive: bool = False) -> Column:
    """A condition on the parts, so that files without such IDs are passed over."""
    after = F.col("seq") > seq if exclusive else F.col("seq") >= seq
    return (F.col("ms") >= ms) & ((F.col("ms") > ms) | after)


def at_most(ms: int, seq: int, exclusive: bool = False) -> Column:
    before = F.col("seq") < seq if exclusive else F.col("seq") <= seq
    return (F.col("ms") <= ms) & ((F.col("ms") < ms) | before)


def newest_first(reverse: bool) -> list[Column]:
    return [F.desc(c) if reverse else F.asc(c) for c in ID]


def xrange(log: DataFrame, start: str | int = "-", end: str | int = "+", count: int | None = None, reverse: bool = False) -> DataFrame:
    """XRANGE, and XREVRANGE with reverse (start and end stay the lower and the upper bound)."""
    out = log.where(at_least(*bound(start, True)) & at_most(*bound(end, False))).orderBy(*newest_first(reverse))
    return out if count is None else out.limit(count)


def xread(log: DataFrame, after: str | int = "0-0", count: int | None = None) -> DataFrame:
    """XREAD: the entries after an ID, oldest first."""
    ms, seq, _ = bound(after, True)
    out = log.where(at_least(ms, seq, exclusive=True)).orderBy(*ID)
    return out if count is None else out.limit(count)


def xread_many(streams: dict[str, tuple[DataFrame, str | int]], count: int | None = None) -> DataFrame:
    """XREAD STREAMS: (stream, the columns) of the entries after each stream's ID, at most count of each; `$` is the last."""
    parts = []
    for name, (log, after) in streams.items():
        after = "{}-{}".format(*last_id(log)) if after == "$" else after
        parts.append(xread(log, after, count).select(F.lit(name).alias("stream"), *log.columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def xlen(log: DataFrame) -> DataFrame:
    """XLEN: (n)."""
    return log.agg(F.count("*").alias("n"))


def last_id(log: DataFrame) -> tuple[int, int]:
    """The greatest ID, which `$` stands for; (0, 0) of an empty log."""
    last = log.agg(F.max(F.struct(*ID)).alias("x")).first()["x"]
    return (0, 0) if last is None else (last["ms"], last["seq"])


def xsetid(log: DataFrame, to: str | int | tuple) -> tuple[int, int]:
    """XSETID: a last ID for xadd to go on from, which is not before the log's own."""
    ms, seq, _ = bound(to, True)
    if (ms, seq) < last_id(log):
        raise ValueError("the ID is before the last entry")
    return ms, seq


def xadd(log: DataFrame, new: DataFrame, order: list[str], ms: Column | None = None, after: tuple[int, int] | None = None, maxlen: int | None = None, minid: str | int | None = None) -> DataFrame:
    """XADD: the log with new rows (the other columns, and ms unless given), in an order without ties, with IDs after the
    last one, or after `after` (of xsetid) if that is later. maxlen and minid trim the log then.

    Rows of one ms get seq from 0 on, or from after the last ID if that has the same ms. An ms before the last ID is
    an error. New rows are numbered as a whole by ms and order, and each ms starts at its least number, so rows of one
    ms are as many tasks as others.
    """
    last = max(last_id(log), after or (0, 0))
    own = (new.withColumn("ms", ms) if ms is not None else new).withColumn("ms", F.col("ms").cast("long"))
    own = numbered(own, [F.col("ms"), *map(F.col, order)], "_n")
    first = own.groupBy("ms").agg(F.min("_n").alias("_first")).withColumnRenamed("ms", "_ms")
    own = look_up(own.withColumn("_ms", F.col("ms")), "_ms", first, "_n")
    own = own.withColumn("seq", (F.col("_n") - F.col("_first") + F.when(F.col("ms") == last[0], last[1] + (last != (0, 0))).otherwise(0)).cast("long"))
    own = own.withColumn("ms", F.when(F.col("ms") < last[0], F.raise_error(F.lit("the ID is not after the last one")).cast("long")).otherwise(F.col("ms")))
    out = log.union(own.select(log.columns))
    return out if maxlen is None and minid is None else xtrim(out, maxlen, minid)


def xtrim(log: DataFrame, maxlen: int | None = None, minid: str | int | None = None) -> DataFrame:
    """XTRIM: exactly the newest maxlen entries, or those from minid on."""
    if minid is not None:
        return log.where(at_least(*bound(minid, True)))
    if maxlen == 0:
        return log.limit(0)
    return log.orderBy(*newest_first(True)).limit(maxlen)


def xdel(log: DataFrame, ids: DataFrame) -> DataFrame:
    """XDEL."""
    return log.join(ids.select(*ID).distinct(), ID, "left_anti").select(log.columns)


def xinfo(log: DataFrame) -> DataFrame:
    """XINFO STREAM: (length, first_ms, first_seq, last_ms, last_seq)."""
    own = log.agg(F.count("*").alias("length"), F.min(F.struct(*ID)).alias("a"), F.max(F.struct(*ID)).alias("b"))
    return own.select("length", F.col("a.ms").alias("first_ms"), F.col("a.seq").alias("first_seq"), F.col("b.ms").alias("last_ms"), F.col("b.seq").alias("last_seq"))


# Groups: deliveries are rows (ms, seq, consumer, delivered_at long, times int), acknowledgements rows (ms, seq).


@dataclass(frozen=True)
class Group:
    """XGROUP: a consumer group of a log that is a table: its last ID, its pending deliveries, and its consumers with the
    time they were last seen. Each change gives a new one."""

    last: tuple[int, int]
    pending: DataFrame
    consumers: dict[str, int] = field(default_factory=dict)

    @classmethod
    def create(cls, log: DataFrame, at: str | int = "$") -> Group:
        """XGROUP CREATE: entries after an ID, `$` being the last one, are still to be delivered."""
        return cls(last_id(log) if at == "$" else bound(at, True)[:2], xreadgroup(log.limit(0), "0-0", "", 0))

    def set_id(self, log: DataFrame, at: str | int) -> Group:
        """XGROUP SETID."""
        return replace(self, last=last_id(log) if at == "$" else bound(at, True)[:2])

    def create_consumer(self, consumer: str, now: int) -> Group:
        """XGROUP CREATECONSUMER."""
        return self if consumer in self.consumers else replace(self, consumers={**self.consumers, consumer: now})

    def delete_consumer(self, consumer: str) -> tuple[int, Group]:
        """XGROUP DELCONSUMER: (how many pending entries went with it, the group after)."""
        gone = self.pending.where(F.col("consumer") == consumer).count()
        left = {k: v for k, v in self.consumers.items() if k != consumer}
        return gone, replace(self, pending=self.pending.where(F.col("consumer") != consumer), consumers=left)

    def read(self, log: DataFrame, consumer: str, now: int, after: str | int = ">", count: int | None = None, noack: bool = False) -> tuple[DataFrame, Group]:
        """XREADGROUP: (entries, the group after). `>` delivers what is new, which is pending unless noack; another ID
        reads the consumer's own pending entries after it again and changes nothing."""
        seen = replace(self, consumers={**self.consumers, consumer: now})
        if after != ">":
            own = self.pending.where(F.col("consumer") == consumer).select(*ID)
            return xread(log.join(own, ID, "left_semi"), after, count), seen
        entries = staged(xread(log, "{}-{}".format(*self.last), count), "read")
        given = xreadgroup(entries, "0-0", consumer, now)
        return entries, replace(seen, last=max(self.last, last_id(entries)), pending=self.pending if noack else self.pending.union(given))

    def ack(self, ids: DataFrame) -> Group:
        """XACK."""
        return replace(self, pending=xack(self.pending, ids))

    def info(self, log: DataFrame, now: int) -> DataFrame:
        """XINFO CONSUMERS: (consumer, pending, idle)."""
        own = self.pending.sparkSession.createDataFrame([(c, now - t) for c, t in sorted(self.consumers.items())], "consumer string, idle long")
        left = self.pending.groupBy("consumer").agg(F.count("*").alias("pending"))
        return own.join(left, "consumer", "left").select("consumer", F.coalesce("pending", F.lit(0)).alias("pending"), "idle")


def xreadgroup(log: DataFrame, last: str | int, consumer: str, now: int, count: int | None = None) -> DataFrame:
    """XREADGROUP with `>`: the entries after the group's last ID as deliveries to a consumer."""
    return xread(log, last, count).select(*ID, F.lit(consumer).alias("consumer"), F.lit(now).cast("long").alias("delivered_at"), F.lit(1).alias("times"))


def xack(deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """XACK: the deliveries that are still pending."""
    return deliveries.join(acks.select(*ID).distinct(), ID, "left_anti").select(deliveries.columns)


def xpending(pending: DataFrame, now: int | None = None, min_idle: int = 0, consumer: str | None = None, start: str = "-", end: str = "+", count: int | None = None) -> DataFrame:
    """XPENDING: by consumer (consumer, n, first_ms, last_ms); with now, the entries with their idle time."""
    if now is None:
        return pending.groupBy("consumer").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    own = pending.where(at_least(*bound(start, True)) & at_most(*bound(end, False))).withColumn("idle", F.lit(now) - F.col("delivered_at")).where(F.col("idle") >= min_idle)
    own = own if consumer is None else own.where(F.col("consumer") == consumer)
    own = own.select(*ID, "consumer", "idle", "times").orderBy(*ID)
    return own if count is None else own.limit(count)


def xclaim(pending: DataFrame, ids: DataFrame, consumer: str, now: int, min_idle: int) -> DataFrame:
    """XCLAIM: pending entries after those of ids that have been idle for long go to a consumer."""
    asked = pending.join(ids.select(*ID).distinct().withColumn("_asked", F.lit(True)), ID, "left")
    moves = F.col("_asked").isNotNull() & (F.lit(now) - F.col("delivered_at") >= min_idle)
    return asked.select(*ID, F.when(moves, consumer).otherwise(F.col("consumer")).alias("consumer"), F.when(moves, now).otherwise(F.col("delivered_at")).cast("long").alias("delivered_at"), (F.col("times") + F.when(moves, 1).otherwise(0)).alias("times"))


def xautoclaim(pending: DataFrame, consumer: str, now: int, min_idle: int, start: str = "0-0", count: int = 100) -> DataFrame:
    """XAUTOCLAIM: the same for the first count entries from start that have been idle for long."""
    idle = pending.where(at_least(*bound(start, True)) & (F.lit(now) - F.col("delivered_at") >= min_idle)).orderBy(*ID).limit(count)
    return xclaim(pending, idle, consumer, now, min_idle)
