"""What the two substring operators share: anchored segments, their repeats, and cutting them out.

Every window of a fixed length is assigned to one *anchor* in it, chosen by the window's content
alone, so equal windows choose equal anchors. Neighbouring windows with one anchor make a *segment*.
Anchors seen once rule out all their windows at once; equal segments repeat each other as a whole;
only where one anchor has different segments must single windows be compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed_texts, text_slices
from tidemark.session import Scratch

ANCHORS = "name long, seg long, doc_id long, lo int, span int"

#: An odd base for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, made once for each process and as long as needed."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


class Prefix:
    """Hashes of any stretch of a sequence, from prefix sums."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.reach(len(values) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


def window_runs(choice: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, count) of each run of consecutive `starts` that made one `choice`."""
    if not len(starts):
        return starts, starts
    head = np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(choice) != 0)))
    at = np.flatnonzero(head)
    return at, np.diff(np.concatenate((at, [len(starts)])))


def place(row: str = "doc_id", at: str = "lo") -> Column:
    return F.struct(F.col(row).alias("doc_id"), F.col(at).alias("lo"))


class Repeats:
    """The anchors that occur more than once, with their segments.

    `occurrences` has a row for every place of such an anchor, `segments` one for every different
    (name, seg): its first and last place. Both are tables in the scratch folder. Counting is partial
    before the shuffle and joins on a name are splittable, so a passage found in a third of all
    documents spreads over many tasks.
    """

    def __init__(self, anchors: DataFrame, label: str):
        self.scratch = Scratch(anchors.sparkSession, label)
        shared = anchors.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
        self.occurrences, _ = self.scratch.write(anchors.join(shared, "name", "left_semi"), "occurrences")
        segments = self.occurrences.groupBy("name", "seg").agg(
            F.min(place()).alias("first"), F.max(place()).alias("last"), F.max("span").alias("span")
        )
        self.segments, _ = self.scratch.write(segments, "segments")

    def repeated(self) -> DataFrame:
        """Segments with more than one place."""
        return self.segments.filter("first != last")

    def mixed(self) -> DataFrame:
        """Segments whose anchor has other segments too, with `segs`, how many."""
        several = self.segments.groupBy("name").agg(F.count(F.lit(1)).alias("segs")).filter("segs > 1")
        return self.segments.join(several, "name")

    def texts(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, need): the documents with a repeated anchor, and the segments to be compared
        whose first place they are. Later steps read these and no other texts."""
        need = self.mixed().groupBy(F.col("first.doc_id").alias("doc_id")).agg(
            F.collect_list(F.struct("name", F.col("first.lo").alias("lo"), "span", "segs")).alias("need")
        )
        every = self.occurrences.select("doc_id").distinct().join(need, "doc_id", "left")
        return self.scratch.write(keyed_texts(docs).join(every, "doc_id"), "texts")[0]


def equal_windows(windows: DataFrame) -> DataFrame:
    """`windows` (h1, h2, doc_id, start, ...) whose two hashes occur at another place, with `first`, the earliest."""
    groups = windows.groupBy("h1", "h2").agg(F.min(place(at="start")).alias("first"), F.max(place(at="start")).alias("last"))
    return windows.join(groups.filter("first != last").select("h1", "h2", "first"), ["h1", "h2"])


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Sorted maximal runs of the union of half-open spans within 0..size."""
    if not spans:
        return []
    a = np.array([s["a"] for s in spans], np.int64)
    b = np.minimum(np.array([s["b"] for s in spans], np.int64), size)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    last = np.concatenate((head[1:], [len(a)])) - 1
    return list(zip(a[head].tolist(), b[last].tolist()))


def cut_out(texts: DataFrame, gone: DataFrame, split: Callable[[bytes], list | bytes], glue: bytes) -> DataFrame:
    """(doc_id, n_removed, n_spans, kept_sha256, text) of the documents with a row in `gone` (doc_id, a, b).

    `split` gives a text's units (its words, or the bytes themselves), which a and b count.
    """
    spans = gone.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = texts.select("doc_id", "text").join(spans, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slice_texts in text_slices(batches, 2 << 20):
            rows = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), slice_texts, batch.column(2).to_pylist()):
                units = split(text)
                runs = merged(spans, len(units))
                bounds = [0, *(x for r in runs for x in r), len(units)]
                kept = [units[a:b] for a, b in zip(bounds[::2], bounds[1::2])]
                left = glue.join(kept if isinstance(units, bytes) else [w for part in kept for w in part])
                rows.append((doc, sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    return joined.mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")
