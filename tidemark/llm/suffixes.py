"""Substring deduplication of bytes by bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import doc_ids, keyed_texts, text_slices, with_row_keys
from tidemark.llm.repeats import ANCHORS, Powers, Prefix, Repeats, cut_out, equal_windows, place, window_runs
from tidemark.session import Scratch

#: Bytes of a repeat, and of the gram whose least hash anchors a window.
LENGTH, GRAM = 100, 24

#: Bytes transformed together, about, and segments of one anchor at most in a block (2 MB of text at most).
BLOCK, MOST_SEGMENTS = 1 << 20, 8000

#: Longest stretch of a text hashed at once.
PIECE = 1 << 20

POWERS, OTHER_POWERS = Powers(), Powers(0xD6E8FEB86659FD93)

#: A random value for each byte.
BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive keys."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def byte_anchors(text: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(name, seg, document, lo, span) of the windows of documents whose bytes lie end to end.

    A window's anchor is the gram in it that hashes lowest, the leftmost of equals.
    """
    ends = np.cumsum(sizes)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(text) < length:
        return none
    first = np.concatenate(([0], ends[:-1]))
    bad = np.zeros(len(text) + 1, np.int32)
    np.add.at(bad, np.maximum(first, ends - length + 1), 1)
    np.add.at(bad, ends, -1)
    starts = np.flatnonzero(np.cumsum(bad[: len(text) - length + 1]) == 0)
    if not len(starts):
        return none
    prefix = Prefix(BYTES[text], POWERS)
    at = np.arange(len(text) - gram + 1)
    names = prefix.of(at, at + gram)
    bits = max(1, len(names).bit_length())
    keys = (names >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    choice = (sliding_least(keys, length - gram + 1)[starts] & np.uint64((1 << bits) - 1)).astype(np.int64)
    run, span = window_runs(choice, starts)
    lo = starts[run]
    seg = prefix.of(lo, lo + span + length - 1)
    owner = np.searchsorted(ends, lo, side="right")
    return names[choice[run]], seg, owner, lo - first[owner], span


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, PIECE):
            ids = doc_ids(batch)
            flat = np.frombuffer(b"".join(texts), np.uint8)
            sizes = np.array([len(t) for t in texts])
            # A text over a piece stands alone in its slice; its pieces overlap, so each window is in one.
            cuts = range(0, max(1, len(flat) - length + 1), PIECE) if len(texts) == 1 else (0,)
            for cut in cuts:
                part = flat[cut : cut + PIECE + length - 1] if len(texts) == 1 else flat
                name, seg, owner, lo, span = byte_anchors(part, np.array([len(part)]) if len(texts) == 1 else sizes, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name.view(np.int64)), pa.array(seg.view(np.int64)), ids.take(pa.array(owner)),
                        pa.array((lo + cut).astype(np.int32)), pa.array(span.astype(np.int32)),
                    ],
                    ["name", "seg", "doc_id", "lo", "span"],
                )

    return keyed_texts(docs).filter(f"doc_id is not null and octet_length(text) >= {length}").mapInArrow(run, ANCHORS)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `text` (small non-negative integers) in the order of their first `depth` symbols or more.

    The symbols compared double each round, and only suffixes that still share theirs with another
    one are sorted again.
    """
    n, known = len(text), 7
    key = np.zeros(n, np.uint64)
    wide = np.concatenate((text, np.zeros(known, text.dtype))).astype(np.uint64)
    for i in range(known):
        key = key * np.uint64(512) + wide[i : i + n]
    order = np.argsort(key)
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    # A rank is the place where the suffix's group of equals starts, so it stays when others are split.
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while known < depth:
        tied = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
        if not len(tied):
            break
        suffix = order[tied]
        later = np.where(suffix + known < n, rank[np.minimum(suffix + known, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + later
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[tied] = suffix
        first = np.concatenate(([True], key[1:] != key[:-1]))
        head[tied] = first
        rank[suffix] = np.maximum.accumulate(np.where(first, tied, 0))
        known *= 2
    return order


def split_ranks(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where, in the order of suffixes, neighbours share fewer than `length` symbols (place r: r-1 and r).

    Breadth first over the strings that occur, by length: a string w has an interval of suffixes, and
    cw, for a symbol c that the transform shows in it, has C[c] + Occ(c, low) .. C[c] + Occ(c, high).
    Both ends are read off the first and the last place of c in the interval, found by the next place
    of the same symbol on either side, so no suffix is sorted here. An interval's right end parts
    suffixes that share exactly the shorter string's length, so common prefixes come out by
    increasing value; an end already known needs no extension. After `length` steps the ends not
    found are those with a longer common prefix. Symbol 0 ends a text: nothing is extended over it.
    """
    n = len(text)
    symbol = np.where(order > 0, text[order - 1], 0).astype(np.int16)
    starts = np.cumsum(np.bincount(text, minlength=int(symbol.max(initial=0)) + 2))
    by_symbol = np.argsort(symbol, kind="stable")
    sorted_symbol = symbol[by_symbol]
    # C[c] + Occ(c, r) for the symbol c at r; and the places of c next to r.
    seen = np.cumsum(np.bincount(symbol, minlength=len(starts)))
    to = np.empty(n, np.int32)
    to[by_symbol] = np.arange(n) - np.concatenate(([0], seen))[sorted_symbol] + np.concatenate(([0], starts))[sorted_symbol]
    alike = sorted_symbol[1:] == sorted_symbol[:-1]
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_symbol[:-1][alike]] = by_symbol[1:][alike]
    preceding[by_symbol[1:][alike]] = by_symbol[:-1][alike]
    # Nothing follows the symbol that ends a text.
    ending = symbol == 0
    following[ending], preceding[ending] = -1, n
    known = np.zeros(n + 1, bool)
    high = np.unique(starts[starts > 0])
    low = np.concatenate(([0], high[:-1]))
    known[low] = known[high] = True
    for _ in range(length - 1):
        sizes = high - low
        total = int(sizes.sum())
        if not total:
            break
        ranks = np.arange(total, dtype=np.int32) + np.repeat((low - np.cumsum(sizes) + sizes).astype(np.int32), sizes)
        # Intervals of one length do not meet, so sorted ends belong together.
        low, high = (
            np.sort(to[ranks[preceding[ranks] < np.repeat(low.astype(np.int32), sizes)]]),
            np.sort(to[ranks[following[ranks] >= np.repeat(high.astype(np.int32), sizes)]]) + 1,
        )
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
    return known


def later_windows(segments: list[bytes], docs: np.ndarray, lows: np.ndarray, spans: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the windows of these segments that equal one with an earlier place, in that order."""
    by = np.lexsort((lows, docs))
    docs, lows, spans = docs[by], lows[by], spans[by]
    text = np.frombuffer(b"\0" + b"\0".join(segments[i] for i in by) + b"\0", np.uint8).astype(np.int16) + 1
    sizes = np.array([len(segments[i]) for i in by])
    at = np.cumsum(sizes + 1) - sizes
    text[at - 1] = 0
    text[-1] = 0
    order = sorted_suffixes(text, length)
    group = np.cumsum(split_ranks(text, order, length)[:-1])
    # Segments lie in the order of their places, so a window's offset in the text tells which is earlier.
    window = np.repeat(np.arange(len(sizes)), spans)
    offset = np.arange(len(window)) - np.repeat(np.cumsum(spans) - spans, spans) + at[window]
    starts = np.zeros(len(text), bool)
    starts[offset] = True
    use = starts[order]
    order, group = order[use], group[use]
    head = np.concatenate(([True], group[1:] != group[:-1]))
    first = np.minimum.reduceat(order, np.flatnonzero(head)) if len(order) else order
    starts[first] = False
    picked = starts[offset]
    window, offset = window[picked], offset[picked]
    return docs[window], lows[window] + offset - at[window]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, most: int = MOST_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of `docs`.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id
    or further left in the same text. Strings are judged on the input and never cross documents.
    `kept` holds the bytes left and is null where nothing was removed. Null, empty and short texts lose
    nothing. A row with a null doc_id is summed up but neither loses nor causes a removal. Rows equal in
    doc_id and text are one document and come out alike; different texts under one doc_id are documents
    of their own, in the order of their SHA-256. Extra columns are ignored.

    Segments of text that anchors show to be shared are dealt into blocks by their anchor, so equal
    strings meet, and each block is transformed and expanded by itself. An anchor with more than
    `most` different segments would make a block of its own grow with the input; its windows are
    compared by two 64-bit hashes instead, aggregated before they are shuffled.
    """
    rows, key, lead = with_row_keys(keyed_texts(docs), "suffix_rows")
    lead_rows = rows.filter(lead).select(F.col(key).alias("doc_id"), "text")
    repeats = Repeats(anchors(lead_rows, length, gram), "suffixes")
    texts = repeats.texts(lead_rows)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slice_texts in text_slices(batches):
            rows = [
                (x["name"], doc, x["lo"], x["span"], text[x["lo"] : x["lo"] + x["span"] + length - 1])
                for doc, text, need in zip(batch.column(0).to_pylist(), slice_texts, batch.column(2).to_pylist())
                for x in need
                if x["segs"] <= most
            ]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["name", "doc_id", "lo", "span", "bytes"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slice_texts in text_slices(batches, PIECE):
            for doc, text, need in zip(batch.column(0).to_pylist(), slice_texts, batch.column(2).to_pylist()):
                for x in need:
                    if x["segs"] > most:
                        part = BYTES[np.frombuffer(text[x["lo"] : x["lo"] + x["span"] + length - 1], np.uint8)]
                        at = np.arange(x["span"])
                        h1, h2 = (Prefix(part, p).of(at, at + length).view(np.int64) for p in (POWERS, OTHER_POWERS))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h1), pa.array(h2), pa.array(np.full(len(at), doc)), pa.array((at + x["lo"]).astype(np.int32))],
                            ["h1", "h2", "doc_id", "start"],
                        )

    def expand(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "lo", "span")]
        doc, start = later_windows(table.column("bytes").to_pylist(), *columns, length)
        run, count = window_runs(doc, start)
        return pa.table({"doc_id": doc[run], "a": start[run], "b": start[run] + count + length - 1})

    needed = texts.filter("need is not null")
    total = repeats.mixed().filter(F.col("segs") <= most).agg(F.sum(F.col("span") + length)).first()[0] or 0
    cut, _ = repeats.scratch.write(
        needed.mapInArrow(segments, "name long, doc_id long, lo int, span int, bytes binary")
        .withColumn("block", F.pmod(F.xxhash64("name"), F.lit(max(1, -(-total // block))))), "segments_cut"
    )
    expanded = cut.groupBy("block").applyInArrow(expand, "doc_id long, a long, b long")
    hot = equal_windows(needed.mapInArrow(windows, "h1 long, h2 long, doc_id long, start int")).filter(place(at="start") != F.col("first"))
    later = repeats.occurrences.join(repeats.repeated().select("name", "seg", "first"), ["name", "seg"]).filter(place() != F.col("first"))
    gone = expanded.union(
        hot.select("doc_id", F.col("start").cast("long").alias("a"), (F.col("start") + length).cast("long").alias("b"))
    ).union(later.select("doc_id", F.col("lo").cast("long").alias("a"), (F.col("lo") + F.col("span") + length - 1).cast("long").alias("b")))
    removed = cut_out(texts, gone, bytes, b"").select(
        F.col("doc_id").alias("_doc"), "n_removed", "n_spans", F.col("kept_sha256").alias("_sha"), "kept"
    )
    whole = rows.select(
        "doc_id", key, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"),
    )
    return whole.join(removed, F.col(key) == F.col("_doc"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("_sha", "sha").alias("kept_sha256"), "kept",
    )
