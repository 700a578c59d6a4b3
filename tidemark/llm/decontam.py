"""Benchmark decontamination with spaced seeds: overlaps that tolerate substituted words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import doc_ids, keyed_texts, text_slices
from tidemark.session import materialize

#: Fixed masks over consecutive words, 1 where a word must agree; 6 ones each. Whichever fifth of the words
#: of a stretch of 12 to 25 is substituted, one of the masks fits between them (longer stretches hold such a one).
MASKS = ("1101111", "111010011", "11100100011")

#: Items with fewer words than this must occur whole.
WHOLE = 12

#: Words an aligned overlap needs, or the whole item if that is shorter, and the share that must agree.
MIN_WORDS, MIN_AGREE = 13, 0.8

#: Seed hashes of the test set sent to the tasks at once (16 bytes each); larger sets go in blocks.
BLOCK_SEEDS = 2_000_000

#: Hits of a mask expanded at once, about.
HITS = 1 << 18

WORD = re.compile(r"\w+")


def word_hashes(text: bytes, known: dict[str, int]) -> np.ndarray:
    """Hashes of the lower-case runs of letters, digits and underscores."""
    out = []
    for w in WORD.findall(text.decode("utf-8", "replace").lower()):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def seed_hashes(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the words under the mask's ones, at every place the mask fits."""
    count = len(words) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, 0x9E3779B97F4A7C15 * (number + 1) % (1 << 64), np.uint64)
    for i, one in enumerate(mask):
        if one == "1":
            total = (total ^ words[i : i + count]) * np.uint64(0x9FB21C651E98DF25)
            total ^= total >> np.uint64(29)
    return total


def diagonal(item: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, np.ndarray]:
    """The first item word that lies on the document when item word i lies on doc word i + shift, and
    for each word from there on whether the two agree."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    return lo, item[lo:hi] == doc[lo + shift : hi + shift]


def stretch(same: np.ndarray, at: int, agree: float) -> tuple[int, int]:
    """[a, b) of the best stretch around place `at`: it grows both ways, scored so that a share below `agree` loses.

    Every place in it has the same best stretch.
    """
    gain = np.where(same, 1 - agree, -agree)
    right = np.concatenate(([0.0], np.cumsum(gain[at:])))
    left = np.concatenate(([0.0], np.cumsum(gain[:at][::-1])))
    return at - int(len(left) - 1 - left[::-1].argmax()), at + int(len(right) - 1 - right[::-1].argmax())


def enough(same: int | np.ndarray, count: int, agree: float) -> bool | np.ndarray:
    return same >= agree * count - 1e-9


def widened(same: np.ndarray, whole: bool, least: int, agree: float) -> tuple[int, int] | None:
    """[a, b) of a stretch of `least` words or more that agrees enough, though no best-scored one is that long.

    Its first and last words agree, unless it is the `whole` item. For each first word the last end is
    taken, and of these the stretch with most agreeing words.
    """
    sums = np.concatenate(([0], np.cumsum(same)))
    if whole and enough(sums[-1], len(same), agree):
        return 0, len(same)
    starts = np.flatnonzero(same)
    if len(same) < least or not enough(len(starts), least, agree):
        return None
    score = sums - agree * np.arange(len(sums))
    further = np.maximum.accumulate(np.where(same, score[1:], -np.inf)[::-1])[::-1]
    ends = np.searchsorted(-further, -(score[starts] - 1e-9), side="right")
    agreeing = np.where(ends - starts >= least, sums[ends] - sums[starts], 0)
    k = int(agreeing.argmax())
    return (int(starts[k]), int(ends[k])) if agreeing[k] else None


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of the test items that hold a word, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch, texts in text_slices(batches):
            words = [word_hashes(t, known).view(np.int64) for t in texts]
            column = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(0, np.int64), *words])),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, words array<long>").filter("item_id is not null and size(words) > 0")


class SeedIndex:
    """The seeds of some test items, sorted by hash, with the items' words to verify against."""

    def __init__(self, rows: Sequence, masks: Sequence[str], least: int):
        self.masks, self.least = masks, least
        self.ids = [r.item_id for r in rows]
        self.items = [np.array(r.words, np.int64).view(np.uint64) for r in rows]
        hashes, owner, place = [], [], []
        span = max(WHOLE, *map(len, masks))
        for k, words in enumerate(self.items):
            for n, mask in enumerate(masks if len(words) >= span else ()):
                h = seed_hashes(words, mask, n)
                hashes.append(h)
                owner.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owner = np.concatenate([np.zeros(0, np.int64), *owner])[order].astype(np.int64)
        self.place = np.concatenate([np.zeros(0, np.int64), *place])[order].astype(np.int64)
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, words in enumerate(self.items):
            if len(words) < span:
                key = int(seed_hashes(words, "1" * len(words), 99)[0])
                self.short.setdefault(len(words), {}).setdefault(key, []).append(k)

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, shift, places in item) of every alignment a seed of the document suggests.

        Seeds are looked up a mask at a time, and at most about `HITS` hits at once, so an alignment
        can come more than once.
        """
        for n, mask in enumerate(self.masks if len(self.hashes) else ()):
            seeds = seed_hashes(words, mask, n)
            first = np.searchsorted(self.hashes, seeds)
            at = np.flatnonzero(self.hashes[np.minimum(first, len(self.hashes) - 1)] == seeds)
            first = first[at]
            counts = np.searchsorted(self.hashes, seeds[at], side="right") - first
            parts = (np.cumsum(counts) - counts) // HITS
            for part in np.unique(parts):
                here = parts == part
                many = counts[here]
                j = np.repeat(first[here] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                item, place = self.owner[j], self.place[j]
                shift = np.repeat(at[here], many) - place
                order = np.lexsort((place, shift, item))
                item, shift, place = item[order], shift[order], place[order]
                heads = np.flatnonzero(np.concatenate(([True], (np.diff(item) != 0) | (np.diff(shift) != 0))))
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(item)]):
                    yield int(item[a]), int(shift[a]), place[a:b]

    def overlaps(self, words: np.ndarray, least: int, agree: float) -> dict[int, tuple[int, int, int, int]]:
        """item -> (start in document, start in item, words, agreeing), the overlap of each with most agreeing words."""
        best: dict[int, tuple[int, int, int, int]] = {}

        def offer(k: int, start: int, a: int, count: int, same: int) -> None:
            old = best.get(k)
            if old is None or (-same, start, a) < (-old[3], old[0], old[1]):
                best[k] = (start, a, count, same)

        tried: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, shift, places in self.hits(words):
            seen = tried.setdefault((k, shift), [])
            lo, same, next_one = 0, None, 0
            while next_one < len(places):
                place = int(places[next_one])
                inside = next((s for s in seen if s[0] <= place < s[1]), None)
                if inside is None:
                    if same is None:
                        lo, same = diagonal(self.items[k], words, shift)
                    a, b = stretch(same, place - lo, agree)
                    inside = (lo + a, lo + b)
                    seen.append(inside)
                next_one = max(next_one + 1, int(np.searchsorted(places, inside[1])))
        for (k, shift), seen in tried.items():
            lo, same = diagonal(self.items[k], words, shift)
            need = min(least, len(self.items[k]))
            whole = [(a, b) for a, b in seen if b - a >= need and enough(same[a - lo : b - lo].sum(), b - a, agree)]
            if not whole:
                wide = widened(same, len(same) == len(self.items[k]), need, agree)
                whole = [(lo + wide[0], lo + wide[1])] if wide else []
            for a, b in whole:
                offer(k, a + shift, a, b - a, int(same[a - lo : b - lo].sum()))
        for size, keys in self.short.items():
            if size >= self.least:
                for i, h in enumerate(seed_hashes(words, "1" * size, 99).tolist()):
                    for k in keys.get(h, ()):
                        offer(k, i, 0, size, size)
        return best


def blocks(items: DataFrame, masks: Sequence[str], bound: int) -> Iterator[list]:
    """The items in lists of at most `bound` seeds (one item at least)."""
    held, seeds = [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        size = len(masks) * len(row.words)
        if held and seeds + size > bound:
            yield held
            held, seeds = [], 0
        held.append(row)
        seeds += size
    yield held


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: Sequence[str] = MASKS,
    min_words: int = MIN_WORDS,
    min_agree: float = MIN_AGREE,
    least_item: int = 6,
    block_seeds: int = BLOCK_SEEDS,
) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_agree): each document's best overlap with each item.

    Every place of every document is hashed under every mask and looked up among the test set's
    seeds; a hit's alignment is extended word by word both ways, from every hit outside the stretches
    already found on it, and kept if `min_words` words (or the whole item) agree in `min_agree` of
    their places. Where no best-scored stretch is that long, one that still agrees in that share is
    looked for on the alignment. Items of under `WHOLE` words (or shorter than a mask) must occur whole, and
    items under `least_item` words are too short to tell and match nothing. The test set goes to the tasks in
    blocks of at most `block_seeds` seeds, one pass over the documents a block, so its size is not
    limited. Null and empty texts on either side match nothing; a null doc_id is reported as null, a
    null item_id is left out, and repeated rows give repeated rows.
    """
    texts = keyed_texts(docs)
    out = None
    for rows in blocks(materialize(item_words(benchmark), "items"), masks, block_seeds):
        index = SeedIndex(rows, masks, least_item)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known: dict[str, int] = {}
            for batch, slice_texts in text_slices(batches):
                if len(known) > 200_000:
                    known.clear()
                got = []
                for doc, text in zip(doc_ids(batch).to_pylist(), slice_texts):
                    best = index.overlaps(word_hashes(text, known), min_words, min_agree)
                    got += [(doc, index.ids[k], *v) for k, v in best.items()]
                columns = list(zip(*got)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_agree"]
                )

        found = texts.mapInArrow(
            run, "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_agree long"
        )
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that overlap a test item."""
    found = materialize(overlaps(docs, benchmark, **options).select("doc_id").filter("doc_id is not null").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
