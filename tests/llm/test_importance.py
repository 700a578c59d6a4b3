"""Importance resampling against a plain reading of its rule."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from test_operators import docs_of, empty, prose

from tidemark.llm import importance


def plain_features(text, grams):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return words, [b" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, grams=2, buckets=10_000, percent=25, least=20, seed=7):
    def bucket(f):
        return zlib.crc32(f) % buckets

    s, t = (Counter(bucket(f) for text in texts for f in plain_features(text, grams)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, found = plain_features(text, grams)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = None if i is None else int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score, len(words)))
    listed = sorted((r for r in rows if r[0] is not None and r[4] >= least), key=lambda r: (-r[3], r[0], r[2], r[1]))
    rank = {id(r): k for k, r in enumerate(listed, 1) if k <= len(listed) * percent // 100}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def test_features_are_the_crcs_of_the_runs_whatever_the_cuts():
    rng = random.Random(3)
    alphabet = ["a", "B", "zé", "日本語", "x1", "w" * 300, "v" * 700, "9"]
    texts = ["", "one", "...!", "A-b", *(" ,\n"[k % 3].join(rng.choice(alphabet) for _ in range(n)) for k, n in enumerate((2, 5, 40, 400)))]
    for grams in (1, 2, 3):
        for limit in (1, 7, 64, 1 << 20):
            got = {}
            for k, n, found in importance.features([t.encode() for t in texts], grams, 1 << 20, limit):
                words, buckets = got.setdefault(k, (0, []))
                got[k] = (words + n, buckets + found.tolist())
            for k, t in enumerate(texts):
                words, runs = plain_features(t, grams)
                assert got.get(k, (0, []))[0] == len(words)
                assert sorted(got.get(k, (0, []))[1]) == sorted(zlib.crc32(f) % (1 << 20) for f in runs)


def test_shift_table_appends_bytes():
    for n in (1, 2, 7, 255, 256, 1000, 65_537):
        head, tail = b"some text", bytes(k % 251 for k in range(n))
        crc, table = zlib.crc32(head), importance.shift_table(n)
        moved = np.bitwise_xor.reduce([table[b, crc >> 8 * b & 255] for b in range(4)])
        assert int(moved) ^ zlib.crc32(tail) == zlib.crc32(head + tail)


def test_resample_equals_plain_reading(spark):
    rng = random.Random(8)
    texts = [None, "", "  ,.", "Word", *(prose(rng, rng.randrange(1, 60)) for _ in range(60)), prose(rng, 9000), "x" * 5000 + " " + prose(rng, 30)]
    ids = [*range(len(texts) - 6), 5, 5, None, None, 7, 7]
    texts[-2] = texts[7]  # an equal row, beside ids that repeat with other texts and null ids
    target = [prose(rng, 40, 50), None, "w1 w2 W3"]
    bench = docs_of(spark, target)
    got = importance.resample(docs_of(spark, texts, ids), bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(list(zip(ids, texts)), target)


def test_resample_of_nothing(spark):
    assert importance.resample(empty(spark), docs_of(spark, ["a b c"])).collect() == []
    rows = [(k, prose(random.Random(k), 30)) for k in range(8)]
    got = importance.resample(docs_of(spark, [t for _, t in rows]), empty(spark))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(rows, [])


def test_resample_does_not_follow_partitions(spark):
    rows = docs_of(spark, [prose(random.Random(k // 2), 25) for k in range(40)])
    first, second = (sorted(map(tuple, importance.resample(rows.repartition(n), rows).collect()), key=repr) for n in (1, 7))
    assert first == second
