"""Language ID by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import mix, staged

#: Hashed n-gram features, and the lengths of n-grams in characters.
FEATURES = 1 << 14
LENGTHS = (1, 2, 3)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A codeword of -1 and 1 for each of n languages: all different splits for up to five languages, else random
    balanced bits, of several draws those whose nearest codewords are furthest apart: a quarter of the bits at least."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 5:
        bits = [[1, *(1 if k >> j & 1 else -1 for j in range(n - 1))] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.int8).T
    rng, size, best = np.random.default_rng(seed), max(15, int(10 * np.ceil(np.log2(n)))), (-1, None)
    draws = 0
    while draws < 20 or best[0] < size // 4:
        draws += 1
        codes = np.array([rng.permutation([1 if k < (n + 1) // 2 else -1 for k in range(n)]) for _ in range(size)], np.int16).T
        apart = (size - codes @ codes.T) // 2
        np.fill_diagonal(apart, size)
        if apart.min() > best[0]:
            best = (int(apart.min()), codes.astype(np.int8))
        size += draws % 20 == 0  # more bits if so many draws were not enough
    return best[1]


def features(text: str, chunk: int = 1 << 20) -> np.ndarray:
    """Counts of hashed n-grams of the whole text, lower-cased; ASCII and Latin-1 signs count as spaces."""
    counts = np.zeros(FEATURES, np.int64)
    text, reach = text.lower(), max(LENGTHS) - 1
    for at in range(0, len(text), chunk):
        own = text[max(0, at - reach) : at + chunk]
        codes = np.frombuffer(own.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes[(codes < 65) | ((codes > 90) & (codes < 97)) | ((codes > 122) & (codes < 170))] = 32
        old = min(at, reach)
        h = np.zeros(len(codes), np.uint64)
        for n in LENGTHS:
            h = h[: len(codes) - n + 1] * np.uint64(1000003) + codes[n - 1 :] if n <= len(codes) else h[:0]
            new = mix(h + np.uint64(n << 56))[max(0, old - n + 1) :]
            counts += np.bincount((new >> np.uint64(50)).astype(np.int64), minlength=FEATURES)
    return counts


def has_letter(text: str | None) -> bool:
    import regex

    return text is not None and regex.search(r"\p{L}", text) is not None


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smooth: float = 0.5, most_languages: int = 1000) -> dict:
    """A model from all rows that have a language and a letter: {languages, codes, weights, bias, trust}.

    Each row's n-gram counts are summed by language, first in each task and then over all, so what comes to the driver
    is FEATURES numbers a language however many rows there are, and more than most_languages different values of the column are an
    error: it holds something else then. From these sums each bit of the code gets a binary
    classifier: the log odds of an n-gram among the languages with the bit set against the others. A bit's trust, the
    weight of its loss, is how far the two sides' n-grams differ (their Jensen-Shannon divergence).
    """
    own = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        sums = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if has_letter(text):
                    sums[lang] = sums.get(lang, 0) + features(text)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "feature": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    sums = staged(own.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")), "features")
    if sums.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"there are more than {most_languages} languages")
    rows = sums.collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return {"languages": []}
    counts = np.zeros((len(languages), FEATURES))
    place = {x: k for k, x in enumerate(languages)}
    for r in rows:
        counts[place[r["lang"]], r["feature"]] = r["n"]
    shares = (counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True)
    codes = codewords(len(languages))
    weights, trust = [], []
    for bit in codes.T:
        on, off = shares[bit > 0].mean(axis=0), shares[bit < 0].mean(axis=0) if (bit < 0).any() else np.full(FEATURES, 1 / FEATURES)
        weights.append(np.log(on) - np.log(off))
        middle = (on + off) / 2
        trust.append(float((on * np.log(on / middle) + off * np.log(off / middle)).sum() / 2))
    trust = np.array(trust)
    return {"languages": languages, "codes": codes, "weights": np.array(weights, np.float32).T.copy(), "trust": trust / trust.sum()}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 20.0, gap: float = 0.1) -> DataFrame:
    """(id, lang_pred, score double, ambiguous boolean) of each row, by its whole text alone.

    A bit's margin is the mean log odds of the text's n-grams. A language's loss is the trust-weighted sum over bits of
    log(1 + exp(-sharpness * codeword bit * margin)); the least loss wins, of equal ones the first by name. score is
    the winner's share of exp(-loss) over all languages, and ambiguous says that the runner-up is within gap of it.
    A text that is null or has no letter is `und` with score 0, and so is every text if nothing was learned.
    """
    languages = model["languages"]

    def run(batches):
        for batch in batches:
            names, scores, close = [], [], []
            for text in batch["_text"].to_pylist():
                if not languages or not has_letter(text):
                    names.append("und")
                    scores.append(0.0)
                    close.append(False)
                    continue
                counts = features(text)
                margin = counts.astype(np.float32) @ model["weights"] / max(1, counts.sum())
                loss = (model["trust"] * np.logaddexp(0, -sharpness * model["codes"] * margin.astype(float))).sum(axis=1)
                share = np.exp(loss.min() - loss) ** len(model["trust"])
                share /= share.sum()
                best = int(share.argmax())
                names.append(languages[best])
                scores.append(float(share[best]))
                close.append(bool(len(share) > 1 and share[best] - np.partition(share, -2)[-2] < gap))
            yield pa.record_batch({"_id": batch["_id"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "ambiguous": pa.array(close, pa.bool_())})

    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    out = own.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("_id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether crc32 of the id as text is 0 modulo folds; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def op6_languages(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
