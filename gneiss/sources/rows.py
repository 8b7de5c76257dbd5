"""Rows from outside: row text, Parquet, JSON and CSV, checked against a table's schema; and results to the outside."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.common import numbered
from gneiss.plans.ddl import UNSIGNED, TableSpec
from gneiss.plans.filters import GS, RS


#: Rows of a chunk in which runs are counted.
RUN_ROWS = 1 << 16


class SchemaError(ValueError):
    """Rows that do not fit the table."""


def check_schema(spec: TableSpec, given: T.StructType) -> None:
    """By position: as many columns, of the same kinds, lists of the same items. Names are not compared."""
    if len(given) != len(spec.schema):
        raise SchemaError(f"{spec.name} has {len(spec.schema)} columns, not {len(given)}")
    for own, other in zip(spec.schema, given, strict=True):
        if own.dataType != other.dataType and not (isinstance(own.dataType, T.ArrayType) and isinstance(other.dataType, T.ArrayType) and own.dataType.elementType == other.dataType.elementType):
            raise SchemaError(f"{spec.name}.{own.name} is {own.dataType.simpleString()}, not {other.dataType.simpleString()}")


def checked(f: T.StructField, c: Column, table: str) -> Column:
    """The value, or an error when the row is read: null where it must not be, a list of another length, an unsigned
    number out of range."""
    fail = lambda said: F.raise_error(F.lit(f"{table}.{f.name}: {said}"))
    c = c.cast(f.dataType)
    if not f.nullable:
        c = F.when(c.isNull(), fail("null is not allowed")).otherwise(c)
    if n := f.metadata.get("length"):
        c = F.when(F.size(c) != n, fail(f"a list has {n} items")).otherwise(c)
    if n := f.metadata.get("item_length"):
        c = F.when(F.exists(c, lambda x: F.size(x) != n), fail(f"a list in the list has {n} items")).otherwise(c)
    if bits := UNSIGNED.get(f.metadata.get("declared", "")):
        c = F.when((c < 0) | (c > 2**bits - 1), fail("out of range")).otherwise(c)
    return c.cast(f.dataType)


def fitted(spec: TableSpec, df: DataFrame, by_name: bool = False) -> DataFrame:
    """df as rows of the table; by_name: columns are found by name and missing ones are null."""
    if not by_name:
        check_schema(spec, df.schema)
        df = df.toDF(*spec.schema.names)
    have = set(df.columns)
    return df.select(*(checked(f, F.col(f"`{f.name}`") if f.name in have else F.lit(None), spec.name).alias(f.name) for f in spec.schema))


def from_text(spec: TableSpec, lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of text: values between 0x1E, list items between 0x1D. There is no null; each column has a value."""
    parts = F.split(F.col(column), RS)
    n = len(spec.schema)
    parts = F.when(F.size(parts) == n, parts).otherwise(F.raise_error(F.concat(F.lit(f"{spec.name} has {n} columns, not "), F.size(parts).cast("string"))))

    def value(f: T.StructField, c: Column) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return F.transform(F.split(c, GS), lambda x: item(f.dataType.elementType, x))
        return item(f.dataType, c)

    def item(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, T.BooleanType):
            return ~F.lower(c).isin("0", "false", "f", "")
        return c.cast(kind)

    split = lines.select(parts.alias("p"))
    return split.select(*(checked(f, value(f, F.col("p")[k]), spec.name).alias(f.name) for k, f in enumerate(spec.schema)))


def read_files(spark: SparkSession, spec: TableSpec, path: str, form: str, **options: str) -> DataFrame:
    """Rows of Parquet (by position), JSON lines (by name, in the table's types) or CSV files (by name; lists in
    brackets or parentheses, read as JSON). Other formats are refused."""
    form = form.lower()
    if form == "parquet":
        return fitted(spec, spark.read.parquet(path))
    if form in ("json", "ndjson"):
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in spec.schema])
        return fitted(spec, spark.read.schema(loose).json(path), by_name=True)
    if form == "csv":
        raw = spark.read.option("header", "true").option("escape", '"').options(**options).csv(path)
        if missing := [f.name for f in spec.schema if f.name not in raw.columns]:
            raise SchemaError(f"the file has no column {', '.join(missing)}")
        return raw.select(*(checked(f, csv_value(f, F.col(f"`{f.name}`")), spec.name).alias(f.name) for f in spec.schema))
    raise SchemaError(f"can't import {form}; there are parquet, json and csv")


def csv_value(f: T.StructField, c: Column) -> Column:
    if not isinstance(f.dataType, T.ArrayType):
        return c
    as_json = F.regexp_replace(F.translate(F.regexp_replace(F.trim(c), ",\\s*\\)", ")"), "()", "[]"), "'", '"')
    as_json = F.regexp_replace(F.regexp_replace(as_json, "\\bTrue\\b", "true"), "\\bFalse\\b", "false")
    return F.from_json(as_json, f.dataType)


def segment_id(spec_or_columns: TableSpec | list[str]) -> Column:
    """The values of the segment columns, joined by 0x1E; empty for a table without any."""
    names = spec_or_columns if isinstance(spec_or_columns, list) else spec_or_columns.segment_columns
    return F.concat_ws(RS, *(F.col(f"`{n}`").cast("string") for n in names)) if names else F.lit("")


def segment_runs(df: DataFrame, segment_columns: list[str], order: list[str], chunk: Column | None = None) -> DataFrame:
    """Numbers, as `run` from 0, the stretches of consecutive rows in whose segment columns nothing changes.

    chunk is a number that rises with the order, many rows to a value; without one rows are numbered by the order, which
    then has no ties, and each RUN_ROWS of them are a chunk. Runs are counted within each chunk, and a table with one row for each chunk says how many began before it and whether the first row goes on with the last run. So
    no task sorts all rows; only the chunks' table is in one order.
    """
    if chunk is None:
        df = numbered(df, [F.col(c) for c in order], "_place")
        chunk, order = F.floor(F.col("_place") / RUN_ROWS), ["_place"]
    own = df.withColumn("_chunk", chunk).withColumn("_segment", F.struct(*(F.col(c) for c in segment_columns)))
    within = Window.partitionBy("_chunk").orderBy(*order)
    before = F.lag("_segment").over(within)
    own = own.withColumn("_new", (before.isNotNull() & ~before.eqNullSafe(F.col("_segment"))).cast("long"))
    key = F.struct(*(F.col(c) for c in order))
    chunks = own.groupBy("_chunk").agg(F.sum("_new").alias("new"), F.min_by("_segment", key).alias("first"), F.max_by("_segment", key).alias("last"))
    across = Window.orderBy("_chunk")
    last = F.lag("last").over(across)
    chunks = chunks.withColumn("turn", (last.isNotNull() & ~last.eqNullSafe(F.col("first"))).cast("long"))
    chunks = chunks.select("_chunk", (F.sum(F.col("new") + F.col("turn")).over(across) - F.col("new")).alias("_base"))
    own = own.withColumn("_at", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(chunks, "_chunk").withColumn("run", F.col("_base") + F.col("_at")).drop("_chunk", "_segment", "_new", "_at", "_base", "_place")


def to_json(df: DataFrame, name: str = "data") -> str:
    """{"schema": ..., "data": [...]} of a result; for results that fit the driver."""
    return json.dumps({"schema": json.loads(df.schema.json()), name: [json.loads(x) for x in df.toJSON().collect()]})


def batch_to_json(df: DataFrame) -> str:
    """The results of a batch search as `data_list`, one list of rows for each query in the order of qid."""
    out: dict[int, list] = {}
    for x in map(json.loads, df.orderBy("qid", "rank").toJSON().collect()):
        out.setdefault(x.pop("qid"), []).append(x)
    return json.dumps({"schema": json.loads(df.schema.json()), "data_list": list(out.values())})


def to_ipc(df: DataFrame) -> bytes:
    """An Arrow stream of a result; empty batches are left out."""
    import pyarrow as pa

    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as to:
        for batch in table.to_batches():
            if batch.num_rows:
                to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())


def to_markdown(df: DataFrame) -> str:
    rows = [df.columns, ["---"] * len(df.columns), *([str(x) for x in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
