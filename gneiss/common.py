"""What all parts share: the folder that every executor sees, tables staged in it, hot-key joins, and positions in an order."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Distinct copies of a key's lookup row, so that a hot key is looked up by this many tasks.
SALTS = 32
_held: dict = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; local-cluster is not."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees; a temporary one only where all is one process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if "path" not in _held:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _held["tmp"] = tempfile.TemporaryDirectory(prefix="gneiss-")
        _held["path"] = f"file://{_held['tmp'].name}"
        atexit.register(_held["tmp"].cleanup)
    return _held["path"]


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/gneiss-{what}-{uuid.uuid4().hex}"
    _held.setdefault("paths", []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def release(spark: SparkSession) -> None:
    """Deletes what this process has staged in the shared folder. Only when no result that was made from it is read any
    more; operators can't know when that is."""
    for table in _held.pop("tables", []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in _held.pop("paths", []):
        delete(spark, path)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages neither recompute it nor depend on an executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, buckets: int, key: str) -> DataFrame:
    """The same as a table with a file for each bucket of a key: joins and groupings by it don't shuffle these rows again. df is
    already dealt by the key to as many partitions, and its rows are compressed."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    name = path.rpartition("/")[2].replace("-", "_")
    _held.setdefault("tables", []).append(name)
    df.write.format("parquet").option("compression", "uncompressed").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def salt(column: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), column), F.lit(salts)).cast("int")


def look_up(rows: DataFrame, key: str, table: DataFrame, spread_by: str) -> DataFrame:
    """rows LEFT JOIN table on key, where table has a key once and rows may have one key very often.

    Each key's row is copied to the salts that rows use for that key, at most SALTS, so no task gets a hot key whole.
    """
    rows = rows.withColumn("_salt", salt(spread_by))
    used = rows.where(F.col(key).isNotNull()).select(key, "_salt").distinct()
    return rows.join(used.join(table, key), [key, "_salt"], "left").drop("_salt")


def numbered(df: DataFrame, order: list[Column], to: str) -> DataFrame:
    """df with `to` (long): each row's place from 0 in an order without ties, without a task that holds all rows.

    Rows are dealt to ranges by a sample of the order's columns, and counted within a range; a table with one row a range
    says how many come before it. The ranges are staged, as a second sample could cut them elsewhere. That table has no
    more rows than spark.sql.shuffle.partitions, so it is a broadcast, and the window over it has no partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = staged(dealt, "numbered").withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_range").select(*(f"`{c}`" for c in df.columns), (F.col("_before") + F.col("_at")).cast("long").alias(to))
