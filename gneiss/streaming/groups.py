"""Logs as Structured Streaming queries: consumer groups over files, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.streaming.logs import ID, xack


class ConsumerGroup:
    """XGROUP, XREADGROUP, XACK over a folder of Parquet files that grows.

    The group's place is the checkpoint of a streaming query, its deliveries and acknowledgements are folders written
    by it: all in shared storage, so a reader that is lost goes on where the group was. A batch that is written again
    after a failure replaces its own folder, so each entry is delivered once to the pending list.
    """

    def __init__(self, spark: SparkSession, source: str, schema: T.StructType, folder: str, max_files: int = 1000):
        self.spark, self.source, self.schema, self.folder, self.max_files = spark, source, schema, folder.rstrip("/"), max_files

    def read(self, consumer: str, now: int) -> int:
        """Delivers what is new to a consumer and returns how many entries that were. For a consumer on a timer, call it
        again; a micro-batch takes max_files files at most."""
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.max_files).parquet(self.source)
        counts = []

        def deliver(batch: DataFrame, number: int) -> None:
            out = batch.select(*ID, F.lit(consumer).alias("consumer"), F.lit(now).cast("long").alias("delivered_at"), F.lit(1).alias("times"))
            path = f"{self.folder}/deliveries/batch={number}"
            out.write.mode("overwrite").parquet(path)
            counts.append(self.spark.read.parquet(path).count())

        query = rows.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(counts)

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def deliveries(self) -> DataFrame:
        return self._table("deliveries", "ms long, seq long, consumer string, delivered_at long, times int")

    def ack(self, ids: DataFrame) -> None:
        ids.select(*(F.col(c).cast("long").alias(c) for c in ID)).write.mode("append").parquet(f"{self.folder}/acks")

    def pending(self) -> DataFrame:
        return xack(self.deliveries(), self._table("acks", "ms long, seq long"))

    def consumers(self) -> DataFrame:
        """XINFO CONSUMERS: (consumer, pending, last_delivered_at)."""
        own = self.deliveries().groupBy("consumer").agg(F.max("delivered_at").alias("last_delivered_at"))
        left = self.pending().groupBy("consumer").agg(F.count("*").alias("pending"))
        return own.join(left, "consumer", "left").select("consumer", F.coalesce("pending", F.lit(0)).alias("pending"), "last_delivered_at")

    def lag(self) -> int:
        """XINFO GROUPS: entries of the log that no consumer was given yet."""
        given = self.deliveries().select(*ID)
        return self.spark.read.schema(self.schema).parquet(self.source).select(*ID).join(given, ID, "left_anti").count()

    def destroy(self) -> bool:
        """XGROUP DESTROY: the group's place, deliveries and acknowledgements go; the log stays."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def watched(rows: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark on an instant; a table as it is."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if rows.isStreaming else rows


def windowed(rows: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts, and sums of a value, by time window and keys; rows later than the watermark are left out of a stream.
    The same function serves a stream and a table."""
    own = watched(rows, time, late)
    frame = F.window(time, width, slide) if slide else F.window(time, width)
    aggs = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    out = own.groupBy(frame.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in out.columns if c != "w"))


def sessions(rows: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): stretches of a key's rows without a gap."""
    own = watched(rows, time, late)
    out = own.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
