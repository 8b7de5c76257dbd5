"""Tables in shared storage that change by whole versions: what blocking pops and active expiry work on."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.common import delete, staged
from gneiss.functions import keys, lists
from gneiss.operators import ranked


class Store:
    """A table as numbered folders, of which the last complete one counts: a writer that is lost leaves the one before.

    There is one writer at a time, as one process serves a key space; readers need no lock.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        own = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = own.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(own):
            return []
        names = [s.getPath() for s in fs.listStatus(own)]
        done = [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.removeprefix("version-")) for n in done if n.startswith("version-"))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version-{self.versions()[-1]}")

    def write(self, df: DataFrame, keep: int = 2) -> None:
        """df as the next version; of those before the last `keep` stay for readers that are at it."""
        there = self.versions()
        df.write.mode("overwrite").parquet(f"{self.path}/version-{there[-1] + 1 if there else 0}")
        for old in there[: max(0, len(there) + 1 - keep)]:
            delete(self.spark, f"{self.path}/version-{old}")


def blocked(attempt: Callable[[], object], timeout: float, every: float = 0.1):
    """What an attempt gives as soon as it isn't None, or None after timeout seconds (0: no end). All commands that wait
    are this with their plain form as the attempt; a writer in between is seen at the next one."""
    end = time.monotonic() + timeout if timeout else None
    while (found := attempt()) is None:
        if end is not None and time.monotonic() + every > end:
            return None
        time.sleep(every)
    return found


def pop_list(store: Store, names: list[str], n: int = 1, from_left: bool = True) -> tuple[str, list] | None:
    """LMPOP over a store (key, value array): (key, items) of the first of these lists that isn't empty, or None."""
    space = store.read()
    found = {r["key"]: r for r in space.where(F.col("key").isin(names) & (F.size("value") > 0)).select("key", (lists.lpop if from_left else lists.rpop)(F.col("value"), n)[0].alias("items")).collect()}
    first = next((k for k in names if k in found), None)
    if first is None:
        return None
    left = (lists.lpop if from_left else lists.rpop)(F.col("value"), n)[1]
    store.write(space.withColumn("value", F.when(F.col("key") == first, left).otherwise(F.col("value"))).where("size(value) > 0"))
    return first, list(found[first]["items"])


def blpop(store: Store, names: list[str], timeout: float, n: int = 1, from_left: bool = True, every: float = 0.1) -> tuple[str, list] | None:
    """BLPOP, BRPOP, BLMPOP."""
    return blocked(lambda: pop_list(store, names, n, from_left), timeout, every)


def pop_ranked(store: Store, names: list[str], n: int = 1, highest: bool = False) -> tuple[str, DataFrame] | None:
    """ZMPOP over a store (key, member, score): (key, popped) of the first of these sets that isn't empty, or None."""
    space = store.read()
    found = ranked.pop_first([space.where(F.col("key") == k) for k in names], n, highest)
    if found is None:
        return None
    k, popped = found[0], staged(found[1], "popped")
    gone = popped.select(F.lit(names[k]).alias("key"), "member")
    store.write(space.join(gone, ["key", "member"], "left_anti").select(space.columns))
    return names[k], popped


def bzpopmin(store: Store, names: list[str], timeout: float, n: int = 1, highest: bool = False, every: float = 0.1) -> tuple[str, DataFrame] | None:
    """BZPOPMIN, BZPOPMAX, BZMPOP."""
    return blocked(lambda: pop_ranked(store, names, n, highest), timeout, every)


def expire_now(store: Store, now: str) -> int:
    """Active expiry: drops the keys that have expired at an instant and says how many rows that were."""
    space = store.read()
    left = keys.live(space, now)
    gone = space.count() - left.count()
    if gone:
        store.write(left)
    return gone
