import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gneiss.llm.bpe import decode, encode, ids_array, op1_bpe, ranks_of

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(PATH), special_tokens={})


def test_odd_rows(odd, library):
    rows = decode(encode(odd, PATH, public_tokenizers.PATTERN), PATH).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert len(rows) == len(texts)
    assert sorted((str(r["doc_id"]), ids_array(r["ids"])) for r in rows) == sorted((str(i), library.encode_ordinary(t)) for i, t in texts)
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted(t.encode() for _, t in texts)


def test_empty_table(odd):
    assert decode(encode(odd.limit(0), PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_special_strings_are_text(documents, library):
    text = "a<|endoftext|>b" + "z" * 3000 + " " * 50 + "\n\n\t  end"
    (row,) = encode(documents([(1, text)]), PATH, public_tokenizers.PATTERN).collect()
    assert ids_array(row["ids"]) == library.encode_ordinary(text)


def test_whole_table(spark, sf, library):
    got = {r["doc_id"]: r for r in op1_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(library.encode_ordinary(r["text"]), "<u4")
        own = got.pop(r["doc_id"])
        assert (own["n_tokens"], own["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert own["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert not got
