"""Quality rules over documents, DataFrame functions only: rules on one text, and line frequency across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import BROADCAST_ROWS, SALTS, staged

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int) -> Column:
    """How many words stand in windows that are found twice or more in the text."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda p: F.filter(F.transform(p, lambda e, k: F.when((F.get(p, k - 1)["h"] == e["h"]) | (F.get(p, k + 1)["h"] == e["h"]), e["i"])), lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + i + window - F.greatest(i, acc["end"])).alias("n"), (i + window).alias("end"))
        return F.aggregate(F.array_sort(twice), start, step, lambda acc: acc["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(F.slice(words, i + 1, window)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) <= window, 0).otherwise(some)


def text_rules(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of a text; null has no words."""
    text = F.coalesce(text, F.lit(""))
    by_words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w, 5).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(by_words, lambda b: F.struct(b["n_words"].cast("long").alias("n_words"), b["word_chars"].cast("long").alias("word_chars"), (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), dup_lines.cast("long").alias("n_dup_lines"), b["n_repeat_words"].cast("long").alias("n_repeat_words")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.array_join(words_of(line), " "))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes, of their words in lower case, are in gone. Blank lines stay."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~F.array_contains(gone, line_hash(F.lower(x))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_percent: int = 20, min_texts: int = 20, max_share: float = 0.1, min_left: float = 0.5, enough_texts: int | None = None, prefix: str = "") -> DataFrame:
    """The documents' columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words (long),
    base_failed, kept (boolean).

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in 5-word windows found twice. A
    line that stands in more than min_texts and more than max_share of the different texts of its host is removed from
    the text, as is one in more than enough_texts of them, if that is given, however many texts the host has; and a document
    of whose words less than min_left are left is rejected, so kept is false. The other values are of the text as it was. A line
    is its words in lower case. Exact copies of a text count once: copying is no sign of boilerplate. Null hosts are one
    host. A null text has no words and fails. Rows with one id and text are judged alike.

    Texts are read twice: once for their lines, staged as narrow rows of hashes from which all counts come, and once for
    the rules and the cut. Line counts cover all documents; per host and line they are summed before and after the shuffle, and a
    frequent line is joined by SALTS tasks. Documents that lose words are joined as a broadcast up to a counted
    number of lines, by a shuffle beyond. The documents' own columns keep their names and come first, but for those that have
    the name of a result, which are replaced; results' names begin with prefix.
    """
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_d"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("_name"), F.col(f"`{host_col}`").isNull().alias("_no_host"))
    marked = marked.withColumn("_content", F.xxhash64(F.coalesce("_text", F.lit("")))).withColumn("_key", F.xxhash64("_id", "_text"))
    line_of = lambda x: let(words_of(x), lambda w: F.struct(F.xxhash64(F.array_join(w, " ")).alias("line"), F.size(w).alias("n")))
    own_lines = F.transform(F.filter(F.split(F.lower("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), line_of)
    rows = marked.select("_key", "_id", "_name", "_no_host", "_content", F.posexplode_outer(own_lines).alias("_at", "_l"))
    lines = staged(rows.select("_key", "_id", "_name", "_no_host", "_content", F.coalesce("_at", F.lit(0)).alias("_at"), "_l.line", "_l.n"), "lines")
    host = ["_name", "_no_host"]
    texts = lines.where("_at = 0").select(*host, "_content").distinct().groupBy(*host).agg(F.count("*").alias("host_texts"))
    counts = lines.where("line IS NOT NULL").select(*host, "line", "_content").distinct().groupBy(*host, "line").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") > min_texts)
    frequent = counts.join(texts, host).where((F.col("n_texts") > max_share * F.col("host_texts")) | (F.col("n_texts") > enough_texts if enough_texts is not None else F.lit(False)))
    frequent = frequent.select(*host, "line", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    salted = lines.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
    removed = salted.join(frequent, [*host, "line", "_salt"]).groupBy("_key", "_id").agg(F.sum("n").alias("_removed"), F.collect_set("line").alias("_gone"))
    copies = lines.where("_at = 0").groupBy("_key", "_id").agg(F.count("*").alias("_copies"))
    removed = removed.join(copies, (removed["_key"] == copies["_key"]) & removed["_id"].eqNullSafe(copies["_id"]), "left").select(removed["_key"], removed["_id"], (F.col("_removed") / F.col("_copies")).cast("long").alias("_removed"), "_gone")
    removed = staged(removed, "removed")
    if (removed.agg(F.sum(F.size("_gone"))).first()[0] or 0) <= BROADCAST_ROWS:
        removed = F.broadcast(removed)
    # As the output of a generator the rules are computed once: filters on them are not taken below it, nor are they inlined.
    rules = marked.select("_d", "_id", "_key", F.explode(F.array(text_rules(F.col("_text")))).alias("_r"))
    both = rules.join(removed, (rules["_key"] == removed["_key"]) & rules["_id"].eqNullSafe(removed["_id"]), "left")
    failed = (F.col("_r.n_words") < min_words) | (100 * F.col("_r.n_repeat_words") > max_repeat_percent * F.col("_r.n_words"))
    gone = F.coalesce("_removed", F.lit(0).cast("long"))
    made = {**{c: F.col(f"_r.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, "n_removed_words": gone, "base_failed": failed, "kept": ~failed & (F.col("_r.n_words") - gone >= min_left * F.col("_r.n_words"))}
    made = {prefix + n: c for n, c in made.items()}
    own = {c: without(F.col(f"_d.`{c}`"), F.col("_gone")) if c == text_col else F.col(f"_d.`{c}`") for c in docs.columns if c not in made}
    return both.select(*(c.alias(n) for n, c in {**own, **made}.items()))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, source IS NULL AS no_host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS w FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS p FROM d WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, p + unnest(generate_series(0, 4)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
raw AS (SELECT doc_id, host, no_host, t, unnest(string_split(t, chr(10))) AS l FROM d),
li AS (SELECT doc_id, host, no_host, t, l, array_to_string(regexp_extract_all(lower(l), '[^\x20\x09-\x0D]+'), ' ') AS nl, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM raw),
lw AS (SELECT * FROM li WHERE n > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lw GROUP BY doc_id),
fr AS (SELECT host, no_host, nl, count(DISTINCT t) AS c FROM lw GROUP BY ALL HAVING count(DISTINCT t) > 20),
hs AS (SELECT host, no_host, count(DISTINCT t) AS c FROM d GROUP BY ALL),
fq AS (SELECT fr.host, fr.no_host, nl FROM fr JOIN hs USING (host, no_host) WHERE fr.c > 0.1 * hs.c),
rm AS (SELECT doc_id, sum(n) AS n FROM lw JOIN fq USING (host, no_host, nl) GROUP BY doc_id),
a AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(rm.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN rm USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM a
"""
