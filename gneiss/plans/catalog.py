"""The catalog: tables that are created, filled, scanned, searched, saved and loaded by name."""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.common import shared_dir
from gneiss.operators import vectors
from gneiss.plans.ddl import DdlError, TableSpec, parse_ddl, to_ddl
from gneiss.plans.filters import parse_filter, segment_part, select_list, to_column
from gneiss.sources.rows import fitted, from_text, read_files, segment_id, to_markdown


class CatalogError(KeyError):
    """A table that is not there, or is there already."""


class Catalog:
    """Tables as Parquet folders under root, with segment columns as partition columns.

    A filter on segment columns therefore prunes folders, and one on other columns reaches the files. A table is the folder
    `root/name`: a definition, and a folder for each insert, which is seen as a whole or not at all, as only complete ones
    count. So another catalog over the same root, in another process too, has the same tables. root is a folder all
    executors share; without one it is a new folder in spark.checkpoint.dir.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, embedder=None):
        self.spark, self.embedder = spark, embedder
        self.root = (root or f"{shared_dir(spark)}/gneiss-catalog-{uuid.uuid4().hex}").rstrip("/")

    # Files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, name: str) -> str:
        return f"{self.root}/{quote(name, safe='')}"

    def _list(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs(path).listStatus(path)) if self._fs(path).exists(path) else []

    def _write_text(self, path: str, text: str) -> None:
        own = self._path(path)
        to = self._fs(own).create(own, True)
        to.write(bytearray(text.encode()))
        to.close()

    def _read_text(self, path: str) -> str | None:
        own = self._path(path)
        if not self._fs(own).exists(own):
            return None
        size, of = self._fs(own).getFileStatus(own).getLen(), self._fs(own).open(own)
        data = of.readNBytes(size)
        of.close()
        return bytes(data).decode()

    def spec(self, name: str) -> TableSpec:
        text = self._read_text(f"{self._folder(name)}/_table.json")
        if text is None:
            raise CatalogError(f"no table {name}")
        said = json.loads(text)
        return TableSpec(said["name"], T.StructType.fromJson(said["schema"]), said["options"])

    def parts(self, name: str) -> list[str]:
        """The folders of the complete inserts; those of a snapshot that was loaded are the snapshot's own."""
        folder = f"{self._folder(name)}/rows"
        own = [f"{folder}/{n}" for n in self._list(folder)]
        return [*self._linked(name), *(p for p in own if self._fs(x := self._path(p, "_SUCCESS")).exists(x))]

    # Definition

    def create(self, table: str | TableSpec, parts: list[str] | None = None, index: str | None = None) -> TableSpec:
        spec = parse_ddl(table) if isinstance(table, str) else table.check()
        path = f"{self._folder(spec.name)}/_table.json"
        if self._read_text(path) is not None:
            raise CatalogError(f"{spec.name} already exists")
        self._write_text(path, self._said(spec, parts or [], index))
        return spec

    @staticmethod
    def _said(spec: TableSpec, parts: list[str], index: str | None = None) -> str:
        return json.dumps({"name": spec.name, "schema": spec.schema.jsonValue(), "options": spec.options, "parts": parts, "index": index})

    def drop(self, name: str) -> None:
        """Forgets a table and deletes its files."""
        self.spec(name)
        path = self._path(self._folder(name))
        self._fs(path).delete(path, True)

    def names(self) -> list[str]:
        found = (self._read_text(f"{self.root}/{n}/_table.json") for n in self._list(self.root))
        return sorted(json.loads(text)["name"] for text in found if text is not None)

    def list_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.names()], "name string")

    def describe(self, name: str) -> DataFrame:
        spec = self.spec(name)
        rows = [(k, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("declared"), f.name in spec.segment_columns) for k, f in enumerate(spec.schema)]
        return self.spark.createDataFrame(rows, "position int, name string, type string, nullable boolean, declared string, is_segment boolean")

    def ddl_of_parquet(self, name: str, path: str) -> str:
        return to_ddl(name, self.spark.read.parquet(path).schema)

    # Rows in

    def _add(self, spec: TableSpec, rows: DataFrame) -> dict:
        began, path = time.monotonic(), f"{self._folder(spec.name)}/rows/_insert={uuid.uuid4().hex}"
        seen = f"rows-{uuid.uuid4().hex}"
        from pyspark.sql import Observation

        watch = Observation(seen)
        rows = rows.observe(watch, F.count(F.lit(1)).alias("n"))
        self._write(spec, rows, path)
        return {"inserted_row_count": watch.get["n"], "schema": spec.schema.simpleString(), "elapsed_time": time.monotonic() - began}

    @staticmethod
    def _write(spec: TableSpec, rows: DataFrame, path: str) -> None:
        copies = rows.select("*", *(F.col(f"`{c}`").alias(f"_segment_{k}") for k, c in enumerate(spec.segment_columns)))
        write = copies.write
        if spec.segment_columns:
            write = write.partitionBy(*(f"_segment_{k}" for k in range(len(spec.segment_columns))))
        write.parquet(path)

    def insert(self, name: str, *texts: str) -> dict:
        """Rows as text; see from_text."""
        spec = self.spec(name)
        return self._add(spec, from_text(spec, self.spark.createDataFrame([(t,) for t in texts], "value string")))

    def insert_json(self, name: str, *texts: str) -> dict:
        """Rows as JSON objects, found by name; missing columns are null."""
        spec = self.spec(name)
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in spec.schema])
        parsed = self.spark.createDataFrame([(t,) for t in texts], "value string").select(F.from_json("value", loose, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        return self._add(spec, fitted(spec, parsed, by_name=True))

    def batch_insert(self, name: str, rows: DataFrame) -> dict:
        """Rows by position, each to the segment of its own values."""
        spec = self.spec(name)
        return self._add(spec, fitted(spec, rows))

    def import_files(self, name: str, path: str, form: str) -> dict:
        spec = self.spec(name)
        return self._add(spec, read_files(self.spark, spec, path, form))

    # Rows out

    def table(self, name: str) -> DataFrame:
        """All rows. Filters on segment columns are taken to the folders by segment_filter."""
        return self._read(self.spec(name), None)

    def _read(self, spec: TableSpec, prune) -> DataFrame:
        fields = [T.StructField(f.name, f.dataType, True, f.metadata) for f in spec.schema]
        folders = [T.StructField(f"_segment_{k}", spec.schema[c].dataType) for k, c in enumerate(spec.segment_columns)]
        parts = self.parts(spec.name)
        if not parts:
            return self.spark.createDataFrame([], T.StructType(fields))
        bases: dict[str, list[str]] = {}
        for path in parts:  # one folder of inserts, and that of a snapshot
            bases.setdefault(path.rpartition("/")[0], []).append(path)
        read = self.spark.read.schema(T.StructType([*fields, *folders, T.StructField("_insert", T.StringType())]))
        out = vectors.union_all([read.option("basePath", base).parquet(*own) for base, own in sorted(bases.items())])
        if prune is not None:
            names = {c: f"_segment_{k}" for k, c in enumerate(spec.segment_columns)}
            renamed = T.StructType([T.StructField(names[f.name], f.dataType) for f in spec.schema if f.name in names])
            out = out.where(to_column(rename(prune, names), renamed))
        return out.select(*(f"`{f.name}`" for f in spec.schema))

    def scan(self, name: str, projection: str = "*", filter: str | None = None) -> DataFrame:
        """The columns that a projection names, in its order, of the rows that a filter keeps."""
        spec = self.spec(name)
        e = parse_filter(filter, spec.schema.names)
        columns = select_list(projection, spec.schema.names)
        rows = self._read(spec, segment_part(e, spec.segment_columns))
        if e is not None:
            rows = rows.where(to_column(e, spec.schema))
        return rows.select(*(f"`{c}`" for c in columns))

    def debug_scan(self, name: str, projection: str = "*", filter: str | None = None) -> str:
        """The rows of a scan as a text table; for what fits a screen."""
        return to_markdown(self.scan(name, projection, filter))

    def segments(self, name: str, filter: str | None = None) -> DataFrame:
        """The segment ids that hold rows, or of these the ones that a filter cannot rule out."""
        spec = self.spec(name)
        prune = segment_part(parse_filter(filter, spec.schema.names), spec.segment_columns)
        return self._read(spec, prune).select(segment_id(spec).alias("segment_id")).distinct()

    def _searched(self, spec: TableSpec, filter: str | None, filter_mode: str) -> DataFrame:
        if filter_mode not in ("rows", "segment"):
            raise ValueError("filter_mode is rows or segment")
        e = parse_filter(filter, spec.schema.names)
        rows = self._read(spec, segment_part(e, spec.segment_columns))
        return rows.where(to_column(e, spec.schema)) if e is not None and filter_mode == "rows" else rows

    def _column(self, spec: TableSpec, size: int | None = None) -> str:
        if spec.ann_column is None:
            raise DdlError(f"{spec.name} has no indexed column")
        n = spec.schema[spec.ann_column].metadata["length"]
        if size not in (None, n):
            raise ValueError(f"{spec.name}.{spec.ann_column} has {n} dimensions, not {size}")
        return spec.ann_column

    def ann(self, name: str, k: int, vector: list[float] | str | None = None, text: str | None = None, ef: int | None = None, projection: str = "*", filter: str | None = None, filter_mode: str = "rows") -> DataFrame:
        """The k nearest rows, nearest first, with `distance` last. vector: numbers, or text of numbers between commas;
        text: given to the embedder. filter_mode rows filters rows before the search, segment prunes segments only. ef is
        accepted; an exact search needs none."""
        spec = self.spec(name)
        if text is not None:
            if self.embedder is None:
                raise ValueError("there is no embedder for a text")
            vector = self.embedder(text)
        if isinstance(vector, str):
            vector = [float(x) for x in vector.split(",")]
        column = self._column(spec, len(vector))
        rows = self._searched(spec, filter, filter_mode)
        names = self._results(spec, projection)
        out = vectors.ann(self._needed(spec, rows, names), vector, k, column, spec.metric, spec.schema.names[0])
        return out.select(*(f"`{c}`" for c in names))

    def batch_ann(self, name: str, k: int, queries: list[list[float]] | DataFrame, ef: int | None = None, projection: str = "*", filter: str | None = None, filter_mode: str = "rows") -> DataFrame:
        """For each query its k nearest rows: qid, rank, the columns, distance. Queries are lists of numbers, with qid from 0, or
        a table of any size with qid and the indexed column."""
        spec = self.spec(name)
        if isinstance(queries, DataFrame):
            column, asked = self._column(spec), queries
            n = spec.schema[column].metadata["length"]
            asked = asked.withColumn(column, F.when(F.size(column) == n, F.col(column)).otherwise(F.raise_error(F.lit(f"{name}.{column} has {n} dimensions"))))
        else:
            if not queries or len({len(q) for q in queries}) != 1:
                raise ValueError("there are queries, of one length")
            column, asked = self._column(spec, len(queries[0])), list(enumerate(queries))
        names = self._results(spec, projection)
        rows = self._needed(spec, self._searched(spec, filter, filter_mode), names)
        out = vectors.batch_ann(rows, asked, k, column, spec.metric, spec.schema.names[0])
        return out.select("qid", "rank", *(f"`{c}`" for c in names))

    def _needed(self, spec: TableSpec, rows: DataFrame, names: list[str]) -> DataFrame:
        """The columns that a search and its result need; the others aren't read."""
        need = {*names, spec.ann_column, spec.schema.names[0]}
        return rows.select(*(f"`{c}`" for c in spec.schema.names if c in need))

    def _results(self, spec: TableSpec, projection: str) -> list[str]:
        out = select_list(projection, [*spec.schema.names, "distance"])
        return out if "distance" in out else [*out, "distance"]

    def indexed_count(self, name: str) -> DataFrame:
        """(total, indexed): rows, and rows with a vector."""
        spec = self.spec(name)
        rows = self.table(name)
        return rows.agg(F.count(F.lit(1)).alias("total"), F.count(spec.ann_column or F.lit(None)).alias("indexed"))

    def indexed_counts(self, names: list[str]) -> DataFrame:
        """(total, indexed) over tables that are parts of one, as nodes report them."""
        counts = vectors.union_all([self.indexed_count(n) for n in names])
        return counts.agg(F.sum("total").alias("total"), F.sum("indexed").alias("indexed"))

    def build_index(self, name: str, **how) -> vectors.CellIndex:
        """An inverted file over a table's vectors, written beside its rows, in place of one that the table had."""
        spec = self.spec(name)
        index = vectors.CellIndex(self.table(name), vector=self._column(spec), tie=spec.schema.names[0], metric=spec.metric, **how)
        index.write(f"{self._folder(name)}/_index-{uuid.uuid4().hex}")
        self._write_text(f"{self._folder(name)}/_table.json", self._said(spec, self._linked(name), index.path))
        return index

    def index(self, name: str) -> vectors.CellIndex | None:
        """The table's index as it was built, or None. Rows inserted since are found after index.add(rows)."""
        self.spec(name)
        path = json.loads(self._read_text(f"{self._folder(name)}/_table.json"))["index"]
        return None if path is None else vectors.CellIndex.open(self.spark, path)

    def _linked(self, name: str) -> list[str]:
        return json.loads(self._read_text(f"{self._folder(name)}/_table.json"))["parts"]

    def is_indexing(self, name: str) -> bool:
        """Never: every row is found as soon as it is in."""
        self.spec(name)
        return False

    # Snapshots

    def save(self, path: str) -> None:
        """All tables and their indexes to path, in the layout they have here; the manifest is written last, so a folder without
        one is no snapshot."""
        path, saved = path.rstrip("/"), []
        for name in self.names():
            spec, to = self.spec(name), f"{path}/{quote(name, safe='')}/rows/_insert={uuid.uuid4().hex}"
            self._write(spec, self.table(name), to)
            index = self.index(name)
            kept = None if index is None else index.write(f"{path}/{quote(name, safe='')}/_index-{uuid.uuid4().hex}").path
            saved.append(json.loads(self._said(spec, [to.removeprefix(f"{path}/")], kept and kept.removeprefix(f"{path}/"))))
        self._write_text(f"{path}/_manifest.json", json.dumps(saved))

    def load(self, path: str) -> None:
        """The tables and indexes of a snapshot, in place of those here. They are read where they are: nothing is copied, and no
        index is built anew."""
        path = path.rstrip("/")
        text = self._read_text(f"{path}/_manifest.json")
        if text is None:
            raise CatalogError(f"no complete snapshot at {path}")
        for name in self.names():
            self.drop(name)
        for said in json.loads(text):
            self.create(TableSpec(said["name"], T.StructType.fromJson(said["schema"]), said["options"]), [f"{path}/{p}" for p in said["parts"]], said["index"] and f"{path}/{said['index']}")


def rename(e, names: dict[str, str]):
    """A filter with its columns under other names."""
    from dataclasses import replace

    if hasattr(e, "parts"):
        return replace(e, parts=tuple(rename(p, names) for p in e.parts))
    if hasattr(e, "part"):
        return replace(e, part=rename(e.part, names))
    return replace(e, column=names[e.column])
