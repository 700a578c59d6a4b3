"""Resampling documents towards a target text by the gains of hashed word features."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import row_numbers
from tidemark.llm.common import doc_ids, keyed_texts, text_slices
from tidemark.session import materialize

#: Buckets that features are counted in.
BUCKETS = 10_000

#: Bytes of text that share one dictionary, about; a dictionary's automaton takes some 100 MB at most.
PIECE = 4 << 20

#: Longer words are not put into the automaton, which would be as deep as they are; their payload is read off the text.
LONG = 256

#: Reflected CRC-32 polynomial, a fixed value.
POLYNOMIAL = 0xEDB88320

#: Bytes a word is made of stay (A-Z in lower case), all others delimit.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def times(matrix: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The 32 x 32 bit matrix (as columns) applied to each of `columns`."""
    bits = (columns[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    return np.bitwise_xor.reduce(np.where(bits, matrix, np.uint32(0)), axis=1)


@lru_cache(maxsize=64)
def zeros(power: int) -> np.ndarray:
    """What 2**power zero bytes make of each bit of a CRC register."""
    if power:
        return times(zeros(power - 1), zeros(power - 1))
    register = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        register = (register >> 1) ^ np.where(register & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return register


@lru_cache(maxsize=2 * LONG)
def shift_table(length: int) -> np.ndarray:
    """4 x 256: what `length` further bytes make of each byte of a CRC, to be combined by exclusive or."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for power in range(length.bit_length()):
        if length >> power & 1:
            columns = times(zeros(power), columns)
    chosen = np.arange(256)[:, None] >> np.arange(8) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(chosen, columns[8 * b : 8 * b + 8], np.uint32(0)), axis=1) for b in range(4)])


class Dictionary:
    """An automaton over the distinct words of some folded texts, each bounded by blanks.

    A word's payload is its CRC, the CRC of a blank and the word, and the length of those two together, which
    is what it takes to append the word to any CRC without its bytes.
    """

    def __init__(self, texts: Iterable[bytes]):
        words = set()
        for t in texts:
            words.update(t.split())
        self.number = {w: k for k, w in enumerate(words)}
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.lead = np.array([zlib.crc32(w, zlib.crc32(b" ")) for w in words], np.uint32)
        lengths, self.length = np.unique([len(w) + 1 for w in words] or [1], return_inverse=True)
        self.shifts = np.stack([shift_table(int(n)) for n in lengths])
        self.long = any(len(w) > LONG for w in words)
        self.found = ahocorasick.Automaton()
        for w, k in self.number.items():
            if len(w) <= LONG:
                self.found.add_word(f" {w.decode('latin-1')} ", k)
        self.found.make_automaton()

    def scan(self, text: bytes) -> np.ndarray:
        """The number of each word of `text`, in order."""
        line = f" {text.decode('latin-1')} "
        hits = self.found.iter(line) if len(self.found) else ()
        if not self.long:
            return np.array([k for _, k in hits], np.int64)
        found = list(hits)
        apart = list(re.finditer(rb"[^ ]{%d,}" % (LONG + 1), text))
        at = np.searchsorted(np.array([e for e, _ in found], np.int64), [m.end() + 1 for m in apart])
        numbers = np.insert(np.array([k for _, k in found], np.int64), at, [self.number[m.group()] for m in apart])
        return numbers

    def appended(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The CRCs of what `crc` stands for, a blank and the word of that number."""
        k = self.length[word]
        out = self.lead[word]
        for b in range(4):
            out = out ^ self.shifts[k, b, crc >> np.uint32(8 * b) & np.uint32(255)]
        return out


def pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """`text` (folded) cut at blanks into pieces of `limit` bytes, or of the one word that is longer."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= limit else text.rfind(b" ", at + 1, at + limit)
        if end < 0:
            end = text.find(b" ", at + limit)
            end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def features(texts: Sequence[bytes], grams: int, buckets: int, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text number, words, buckets of all its features) for every piece of every text.

    A feature of several words is made of payloads alone: the CRC of all but its last word, shifted by that word.
    What a cut parts is carried over: the CRCs of the features that end at the piece's last word.
    """
    folded = [t.translate(FOLDED) for t in texts]
    whole = sum(map(len, folded)) <= 2 * limit
    groups = [[(k, t) for k, t in enumerate(folded)]] if whole else [[(k, p)] for k, t in enumerate(folded) for p in pieces(t, limit)]
    before, tails = -1, []
    for group in groups:
        words = Dictionary(t for _, t in group)
        for k, text in group:
            if k != before:
                before, tails = k, []
            numbers = words.scan(text)
            if not len(numbers):
                continue
            crc, last = words.crc[numbers], tails
            out, tails = [crc], [crc[-1:]]
            for n in range(1, grams):
                # The features of n words that a further word follows: those of this piece, after the one the last piece ended on.
                carried = last[n - 1] if n <= len(last) else crc[:0]
                led = np.concatenate((carried, crc[:-1]))
                crc = words.appended(led, numbers[len(numbers) - len(led) :]) if len(led) else crc[:0]
                out.append(crc)
                if not len(crc):
                    break
                tails.append(crc[-1:])
            yield k, len(numbers), np.concatenate(out) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, grams: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows of `docs` fall into each bucket: a row for each bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in text_slices(batches):
            for _, _, found in features(texts, grams, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed share of each bucket in the target over that in the corpus."""
    more, all_s, all_t = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (all_s + more) / ((s + 1) * (all_t + more)))) for s, t in zip(corpus.astype(float), target.astype(float))], np.int64
    )


def luck(doc_id: int, seed: int) -> int:
    """The Gumbel draw of a document, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, grams: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row; the gains of all buckets go to every task."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            words, count, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for k, n, found in features(texts, grams, buckets):
                words[k] += n
                count[k] += len(found)
                total[k] += gains[found].sum()
            weight = total // np.maximum(count, 1)
            ids = doc_ids(batch)
            score = [None if i is None else w + luck(i, seed) for i, w in zip(ids.to_pylist(), weight.tolist())]
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (words, count, weight)), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"]
            )

    return keyed_texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, grams: int = 2, buckets: int = BUCKETS, percent: int = 25, least_words: int = 20, seed: int = 7
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of `docs`, drawn towards the texts of `target`.

    Features are the runs of 1 to `grams` words, counted in `buckets` buckets over all rows of either
    table. Of the documents with at least `least_words` words, `percent` in a hundred are drawn (rounded
    down), by highest score, ties to the smaller doc_id; the rank of the others is null. Null and empty texts have
    no features and weight 0. A row with a null doc_id counts as text, and has no score and no rank. Rows that
    repeat a doc_id are documents of their own; those that tie go by weight and number of features, and rows equal in
    all of that are drawn in any order. An empty target gives every bucket the corpus's own rarity. Extra columns are
    ignored.
    """
    if buckets < 1 or grams < 1:
        raise ValueError("there must be buckets and words in a feature")
    gains = gains_of(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    scored = materialize(scores(docs, gains, grams, seed), "scores")
    listed = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = scored.filter(listed).count() * percent // 100
    entered = scored.filter(listed).withColumns({"_low": -F.col("score"), "_salt": F.monotonically_increasing_id()})
    ranked = row_numbers(entered, [], ["_low", "doc_id", "weight", "n_features", "_salt"], "rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")
    others = scored.filter(~F.coalesce(listed, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.alias("rank")).union(others)
