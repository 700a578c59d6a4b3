"""Rows that repeat a doc_id: as many rows out as in, every text judged by itself, copies alike."""

import hashlib
import random

import pytest

from tidemark.llm import lines, recompress, suffixes
from tidemark.llm.common import with_row_keys

DOCS = "doc_id long, text string, _row string, _lead int, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, len(t or "")) for i, t in rows], DOCS).repartition(5)


def words(seed, n=80, sep=" "):
    rng = random.Random(seed)
    return sep.join(f"w{rng.randrange(10**6)}" for _ in range(n))


A, B, C = words(1), words(2), words(3)


def digests(found):
    return sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in found.collect()), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_keys_follow_ids_and_tell_texts_apart(spark):
    rows = [(2, A), (1, B), (1, A), (1, A), (None, A), (1, None), (1, "")]
    keyed, key, lead = with_row_keys(docs_of(spark, rows), "keys")
    got = keyed.collect()
    assert (key, lead) == ("__row", "__lead")
    by_row = {(r.doc_id, r.text or ""): r[key] for r in got}
    assert len(got) == len(rows) and len({k for k in by_row.values() if k is not None}) == 4
    assert by_row[2, A] > max(v for (i, _), v in by_row.items() if i == 1) and by_row[None, A] is None
    assert sorted(r[lead] for r in got if r.doc_id == 1 and r.text == A) == [False, True]
    plain, key, _ = with_row_keys(docs_of(spark, [(5, A), (3, A), (None, B), (None, B)]), "keys")
    assert sorted(str(r[key]) for r in plain.collect()) == ["3", "5", "None", "None"]


@pytest.mark.parametrize("copies", [1, 5, 300])
def test_bytes_under_a_repeated_id(spark, copies):
    rows = [(0, A)] + [(1, A)] * copies + [(1, B), (2, C), (None, A)]
    got = digests(suffixes.suffix_dedup(docs_of(spark, rows)))
    gone = (1, len(A), sha(""))
    assert got == sorted([(0, 0, sha(A)), (1, 0, sha(B)), (2, 0, sha(C)), (None, 0, sha(A))] + [gone] * copies, key=str)


@pytest.mark.parametrize("copies", [1, 5, 300])
def test_words_under_a_repeated_id(spark, copies):
    rows = [(0, A)] + [(1, A)] * copies + [(1, B), (2, C), (None, A)]
    got = digests(recompress.substring_dedup(docs_of(spark, rows)))
    assert got == sorted([(0, 80, sha("")), (1, 0, sha(B)), (2, 0, sha(C)), (None, 0, sha(A))] + [(1, 80, sha(""))] * copies, key=str)


def test_different_texts_of_one_id_that_share_a_passage(spark):
    rows = [(1, A + "|" + B), (1, A + "-" + C), (1, A + "-" + C)]
    found = suffixes.suffix_dedup(docs_of(spark, rows)).collect()
    # The text with the smaller digest keeps the passage; its copy comes out like it.
    first = min((A + "|" + B, A + "-" + C), key=sha)
    assert sorted(r.n_removed for r in found) == sorted([len(A) if t != first else 0 for _, t in rows])


@pytest.mark.parametrize("copies", [1, 5, 300])
def test_lines_under_a_repeated_id(spark, copies):
    a, b = words(4, 9, "\n"), words(5, 9, "\n")
    rows = [(0, a)] + [(1, a)] * copies + [(1, b), (2, None), (None, a)]
    got = lines.line_dedup(docs_of(spark, rows)).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.text, r.n_removed) for r in got], key=key) == sorted(
        [(0, a, 0), (1, b, 0), (2, None, 0), (None, a, 0)] + [(1, "", 9)] * copies, key=key
    )
