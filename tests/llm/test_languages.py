import numpy as np
import pytest

from gneiss.llm.languages import FEATURES, codewords, features, learn, op6_languages, predict


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 40])
def test_codewords_differ(n):
    codes = codewords(n)
    assert len({tuple(c) for c in codes}) == n
    if n == 4:
        assert codes.shape[1] == 7 and all((a != b).sum() == 4 for k, a in enumerate(codes) for b in codes[:k])


def test_features_cover_whole_texts():
    text = "Añ ß x1," * 500
    assert (features(text) == features(text, chunk=777)).all()
    assert features(text).shape == (FEATURES,)


def test_odd_rows(odd, spark):
    model = learn(odd)
    out = {r["doc_id"]: r for r in predict(odd, model).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[3]["lang_pred"] == "und" and out[1]["score"] == 0
    assert out[5]["lang_pred"] == "en" and 0 <= out[5]["score"] <= 1
    empty = learn(odd.limit(0))
    assert {r["lang_pred"] for r in predict(odd, empty).collect()} == {"und"}
    assert predict(odd.limit(0), model).count() == 0


def test_predictions_depend_on_the_text_alone(spark):
    rows = [(k, t, "l" + t[0], None) for k, t in enumerate(["aaa bbb", "zzz yyy", "aab aba", "zyz zzy"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = learn(df)
    out = {r["text"]: r["lang_pred"] for r in predict(df, model).join(df.select("doc_id", "text"), "doc_id").collect()}
    assert out["aaa bbb"] == "la" and out["zyz zzy"] == "lz"


@pytest.mark.parametrize("n", [6, 9, 40, 120])
def test_codewords_are_far_apart(n):
    codes = codewords(n)
    least = min(int((a != b).sum()) for k, a in enumerate(codes) for b in codes[:k])
    assert least >= codes.shape[1] // 4


def plain_features(text):
    """Counts by loops over characters and whole-number hashes."""
    mask, out = (1 << 64) - 1, {}
    codes = [32 if c < 65 or 90 < c < 97 or 122 < c < 170 else c for c in map(ord, text.lower())]
    for n in (1, 2, 3):
        for k in range(len(codes) - n + 1):
            h = 0
            for c in codes[k : k + n]:
                h = (h * 1000003 + c) & mask
            x = (h + (n << 56)) & mask
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
            x ^= x >> 31
            out[x >> 50] = out.get(x >> 50, 0) + 1
    return out


@pytest.mark.parametrize("labels", ["ab", "abcd", "abcdefgh"])
def test_learning_and_decoding_by_loops(spark, labels):
    import math
    import random

    rng = random.Random(len(labels))
    letters = {x: [rng.choice("aeioulnrst\u00e9\u00df\u0438") for _ in range(6)] for x in labels}
    rows = [(k, " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))), x) for k, x in enumerate(labels * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    shares, languages = [], sorted(labels)
    for x in languages:
        counts = {}
        for _, t, y in rows:
            if x == y:
                for f, c in plain_features(t).items():
                    counts[f] = counts.get(f, 0) + c
        total = sum(counts.values()) + 0.5 * FEATURES
        shares.append([(counts.get(f, 0) + 0.5) / total for f in range(FEATURES)])
    codes = codewords(len(languages)).tolist()
    weights, trust = [], []
    for bit in range(len(codes[0])):
        sides = [[s for s, c in zip(shares, codes, strict=True) if c[bit] == sign] for sign in (1, -1)]
        on, off = ([sum(s[f] for s in side) / len(side) for f in range(FEATURES)] for side in sides)
        weights.append([math.log(p / q) for p, q in zip(on, off, strict=True)])
        trust.append(sum((p * math.log(2 * p / (p + q)) + q * math.log(2 * q / (p + q))) / 2 for p, q in zip(on, off, strict=True)))
    got = {r["doc_id"]: r for r in predict(df, learn(df)).collect()}
    for who, text, _ in rows:
        own = plain_features(text)
        n = sum(own.values())
        margins = [sum(w[f] * c for f, c in own.items()) / n for w in weights]
        losses = [sum(t / sum(trust) * math.log1p(math.exp(-20.0 * c * m)) for t, c, m in zip(trust, code, margins, strict=True)) for code in codes]
        odds = [math.exp((min(losses) - x) * len(trust)) for x in losses]
        best = max(range(len(languages)), key=lambda k: odds[k])
        assert abs(got[who]["score"] - max(odds) / sum(odds)) < 1e-3
        assert got[who]["lang_pred"] == languages[best] or sorted(odds)[-2] > 0.999


def test_too_many_languages(spark):
    df = spark.createDataFrame([(k, "abc", f"l{k}") for k in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        learn(df, most_languages=8)


def test_held_out_accuracy(spark, sf):
    import zlib

    out = op6_languages(spark, sf)
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = out.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in own]) > 0.95
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
