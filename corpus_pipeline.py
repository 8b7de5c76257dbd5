"""From raw documents to packed sequences in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import new_path, small, staged
from gneiss.llm.lines import dedup_lines
from gneiss.llm.packing import pack_best_fit
from gneiss.llm.quality import quality_rules
from gneiss.llm.simhash import similar_groups
from gneiss.llm.substrings import dedup_substrings


#: A line in more different texts of a host than this is boilerplate, however large the host.
ENOUGH_TEXTS = 40
#: What the names of the operators' results begin with, so that no column of the documents is taken for one.
OWN = "_stage_"


def columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars after what was cut."""
    return out.withColumn("n_chars", F.length("text").cast("long")).select(columns(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that are frequent on their host. Empty input gives empty
    output, here and below."""
    return as_documents(quality_rules(docs, enough_texts=ENOUGH_TEXTS, prefix=OWN).where(f"{OWN}kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier line is within one edit of; lines under 20 characters go if an
    earlier one is equal, and blank ones stay."""
    return as_documents(dedup_lines(docs, min_exact=1, prefix=OWN), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of all 5-word shingles in common) the document with the smallest id; documents
    without an id stay."""
    groups = similar_groups(docs.select("doc_id", "text"))
    gone = small(staged(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies"))
    return docs.join(gone, "doc_id", "left_anti").select(columns(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages of 50 words or more that a document with a smaller id has."""
    return as_documents(dedup_substrings(docs, prefix=OWN), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of the documents go in sequences of 2048 tokens; null texts are empty, and empty input gives none."""
    import public_tokenizers

    return pack_best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("substrings", substrings), ("packing", packing)]

#: SQL has no tokenizer, XXH64 or packing, so the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
