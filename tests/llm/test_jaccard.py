"""The similarity join against all pairs of plain sets."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from test_operators import docs_of, empty, prose

from tidemark.llm import jaccard


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(rows, percent=80):
    sets = [plain_set(t) if i is not None else set() for i, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(plain_set(t)), None if i is None else least[find(k)]) for k, (i, t) in enumerate(rows)), key=repr)


def ours(spark, rows, **how):
    found = jaccard.jaccard_components(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]), **how)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice(([], [f"new{rng.randrange(10**6)}"], [words[k], f"more{rng.randrange(10**6)}"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies about the threshold, small sets, a shared passage, and awkward texts."""
    rng = random.Random(11)
    passage = prose(rng, 40)
    texts = [None, "", " \n\t", "One", "one", "two words", "Two  WORDS", "a b c d", "a b c d e", "é b c d e f", prose(rng, 3000)]
    for size in (8, 12, 15, 20, 60, 150):
        for _ in range(4):
            base = prose(rng, size, 5000)
            texts += [base, *(changed(rng, base, rng.randrange(1, 2 + size // 25)) for _ in range(4))]
    texts += [passage + " " + prose(rng, rng.randrange(1, 40), 4000) for _ in range(30)]
    chain = prose(rng, 200, 9000)
    for _ in range(12):
        texts.append(chain)
        chain = changed(rng, chain, 3)
    texts += [texts[-1], texts[12], texts[12]]
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (3, prose(rng, 70)), (3, "one"), (None, texts[12]), (None, "free text that is by itself here"), (None, None)]


def test_equals_all_pairs(spark, corpus):
    assert ours(spark, corpus) == plain_components(corpus)


@pytest.mark.parametrize("how", ["scanned", "listed", "dealt", "enumerated"])
def test_every_way_gives_the_same(spark, corpus, how, monkeypatch):
    if how == "dealt":
        monkeypatch.setattr(jaccard, "LIST", 2)
    if how == "enumerated":
        monkeypatch.setattr(jaccard, "boundary", lambda *_: jaccard.MOST_SMALL + 1)
    if how == "scanned":
        monkeypatch.setattr(jaccard, "boundary", lambda *_: 1)
    assert ours(spark, corpus, rounds=0 if how in ("listed", "dealt") else jaccard.ROUNDS) == plain_components(corpus)


def test_repeats_of_one_document(spark):
    rows = [(k % 3, "the same few words in every row of it") for k in range(300)] + [(9, None)] * 5
    assert ours(spark, rows) == sorted([(k % 3, 5, 0) for k in range(300)] + [(9, 0, 9)] * 5, key=repr)


def test_nothing(spark):
    assert jaccard.jaccard_components(empty(spark)).collect() == []


def test_prefixes_and_needs_leave_no_pair_out():
    for a in range(1, 60):
        for b in jaccard.partner_sizes(a, 80):
            need = jaccard.needed(a, b, 80)
            assert 100 * need >= 80 * (a + b - need) and 100 * (need - 1) < 80 * (a + b - need + 1)
            assert need <= min(a, b) and jaccard.prefix(a, 80) >= a - need + 1
        assert a in jaccard.partner_sizes(a, 80)


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(2)
    for n in (3, 40, 900):
        one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        two = np.unique(np.concatenate((one[: n // 2], rng.integers(0, 2**63, n).astype(np.uint64))))
        bits = np.bitwise_count((jaccard.parity(one) ^ jaccard.parity(two)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(one, two))


def test_long_parities(spark):
    """No linked pair is turned away, folded or not; unrelated large sets are."""
    rng = np.random.default_rng(4)
    rows, linked = [], []
    for n in (900, 1025, 1100, 2047, 2060, 4090, 9000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for away in (0, 0.08, 0.1, 0.12, 0.9):
            other = np.unique(np.concatenate((base[int(n * away) :], rng.integers(0, 2**63, int(n * away * rng.choice([0.5, 1, 1.1]))).astype(np.uint64))))
            one = np.unique(base)
            common = len(np.intersect1d(one, other))
            linked.append(100 * common >= 80 * (len(one) + len(other) - common))
            rows.append((len(rows), *((len(x), jaccard.long_parity(x).tolist()) for x in (one, other))))
    kind = "struct<size:long,long:array<long>>"
    found = spark.createDataFrame(rows, f"at long, x {kind}, y {kind}").select("at", jaccard.may_link_long("x", "y", 80).alias("may"))
    may = [r.may for r in sorted(found.collect())]
    assert all(m for m, yes in zip(may, linked) if yes) and 14 < sum(linked) < 35
    assert not any(m for m, r in zip(may[4::5], rows[4::5]) if r[1][1] and r[2][1])
    assert [len(jaccard.long_parity(np.arange(n, dtype=np.uint64))) for n in (1024, 1025, 2048, 2049)] == [0, 32, 32, 64]


def test_large_sets_equal_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for size in (1020, 2040, 2300):
        base = prose(rng, size, 6000)
        texts += [base, *(changed(rng, base, size * share // 1000) for share in (15, 20, 22, 24, 26, 35))]
    rows = list(enumerate(texts))
    assert ours(spark, rows) == plain_components(rows)
    assert ours(spark, rows, rounds=0) == plain_components(rows)


def test_hashes_follow_the_words_alone(monkeypatch):
    rng = random.Random(6)
    texts = ["", " ", "One", "a\tb", "A  B", "x" * 300, "a\0", "é ü " * 9, *(prose(rng, rng.randrange(1, 80)) for _ in range(40))]
    raw = [t.encode() for t in texts]
    alone = [jaccard.shingle_sets([t], 5)[0].tolist() for t in raw]
    assert [s.tolist() for s in jaccard.shingle_sets(raw, 5)] == alone
    monkeypatch.setattr(jaccard, "PIECE", 16)
    assert [s.tolist() for s in jaccard.shingle_sets(raw, 5)] == alone
    assert [len(s) for s in alone] == [len(plain_set(t)) for t in texts]
    assert alone[3] == alone[4] and alone[2] != alone[6]


def test_a_pair_is_listed_where_it_is_first_found(spark, monkeypatch):
    """Large sets that share passages without linking were listed once for each common shingle."""
    rng = random.Random(21)
    first, second = prose(rng, 500, 9000), prose(rng, 300, 9000)
    texts = [f"{first} {prose(rng, 1000, 9000)}" for _ in range(6)] + [f"{first} {second} {prose(rng, 700, 9000)}" for _ in range(4)]
    texts += [texts[0], changed(rng, texts[1], 20), changed(rng, texts[7], 20)]
    rows = list(enumerate(texts))
    listed, allowed = [], jaccard.allowed

    def counted(pairs, *rest):
        both = [tuple(sorted(r)) for r in pairs.collect()]
        listed.append((len(both), len(set(both))))
        return allowed(pairs, *rest)

    unordered = np.arange(1 << jaccard.CLASS_BITS, dtype=np.uint64), np.ones(1 << jaccard.CLASS_BITS, np.int64)
    monkeypatch.setattr(jaccard, "class_ranks", lambda _: unordered)
    monkeypatch.setattr(jaccard, "allowed", counted)
    assert ours(spark, rows, rounds=0) == plain_components(rows)
    (rows_listed, pairs_listed), = listed
    assert 20 < pairs_listed <= rows_listed < 2 * pairs_listed


def test_distinct_lists(spark):
    """Of lists with the same members the first one stays; tokens are ordered as unsigned."""
    kept = {3: "abc", -9: "ab", 5: "bc"}
    lists = kept | {7: "abc", -1: "abc", -2: "ab", 6: "bc", 1: "a", 2: "c"}
    lists = spark.createDataFrame([(t, k % 2, ord(m)) for t, ms in lists.items() for k, m in enumerate(ms)], "token long, part int, label long")
    found = {}
    for r in jaccard.distinct_lists(lists).collect():
        found[r.token] = "".join(sorted(found.get(r.token, "") + chr(r.label)))
    assert found == kept
