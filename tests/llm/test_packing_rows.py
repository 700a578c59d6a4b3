"""Packed texts of rows that a doc_id does not tell apart."""

import random

from tidemark.llm import packing

DOCS = "doc_id long, text string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(range(len(texts)) if ids is None else ids, texts)), DOCS)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(200)}" for _ in range(n))


def test_packed_texts_of_null_and_repeated_ids(spark):
    rng = random.Random(7)
    rows = [prose(rng, n) for n in (30, 200, 5, 90, 150, 64, 64, 300, 12)]
    sequences = packing.packed_sequences(docs_of(spark, rows, [None, None, 4, 4, 4, 9, None, 4, 9]), (16, 64, 128)).collect()
    assert sorted(w for s in sequences for w in s.text.split()) == sorted(w for t in rows for w in t.split())
    assert all(s.n_words == len(s.text.split()) <= s.capacity for s in sequences)
    only = packing.packed_sequences(docs_of(spark, ["a b", "c d e"], [None, None])).collect()
    assert [(s.n_words, s.doc_ids) for s in only] == [(5, [None, None])]
