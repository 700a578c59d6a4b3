"""Substring deduplication of words by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import doc_ids, keyed_texts, text_slices, with_row_keys
from tidemark.llm.repeats import ANCHORS, Powers, Prefix, Repeats, cut_out, equal_windows, mix, window_runs
from tidemark.session import Scratch

#: Words in a window, rounds of recompression, and the words beside a symbol that may decide on it.
WINDOW, ROUNDS, CONTEXT = 35, 3, 8

#: Beyond any position: what a symbol depends on that lies outside its document.
OUTSIDE = 1 << 40

POWERS, OTHER_POWERS = Powers(), Powers(0xD6E8FEB86659FD93)


def recompress(symbols: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, from, to) of the symbols left after `rounds`, in words.

    A round names each maximal run of one symbol, then each pair of a left symbol followed by a right
    one; a hash of the symbol and the round sorts symbols into left and right. Names are hashes of
    what they stand for, so all tasks give one content one name and no table of names is kept. Words
    from..to decide that the symbol stands where it does: a text that holds these words holds it.
    """
    start = np.arange(len(symbols))
    stop, low, high = start + 1, start.copy(), start + 1
    for n in range(rounds):
        if not len(symbols):
            break
        apart = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(np.concatenate(([True], apart)))
        tail = np.concatenate((head[1:], [len(symbols)])) - 1
        count = tail - head + 1
        before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, len(symbols) - 1)
        inner_left, inner_right = (head > 0) & (doc[before] == doc[head]), (tail + 1 < len(symbols)) & (doc[after] == doc[tail])
        new_low = np.minimum(np.minimum.reduceat(low, head), np.where(inner_left, low[before], -OUTSIDE))
        new_high = np.maximum(np.maximum.reduceat(high, head), np.where(inner_right, high[after], OUTSIDE))
        named = mix(symbols[head] * np.uint64(0xA24BAED4963EE407) + count.astype(np.uint64))
        symbols = np.where(count > 1, named, symbols[head])
        start, stop, low, high, doc = start[head], stop[tail], new_low, new_high, doc[head]

        left = (mix(symbols + np.uint64(n + 1)) & np.uint64(1)) == 0
        beside = doc[1:] == doc[:-1]
        pair = left[:-1] & ~left[1:] & beside
        leads, follows = np.concatenate((pair, [False])), np.concatenate(([False], pair))
        next_low = np.concatenate((np.where(beside, low[1:], -OUTSIDE), [-OUTSIDE]))
        next_high = np.concatenate((np.where(beside, high[1:], OUTSIDE), [OUTSIDE]))
        last_low = np.concatenate(([-OUTSIDE], np.where(beside, low[:-1], -OUTSIDE)))
        last_high = np.concatenate(([OUTSIDE], np.where(beside, high[:-1], OUTSIDE)))
        # A left symbol looks at what follows it, a right one at what precedes it.
        low = np.minimum(low, np.where(left, next_low, last_low))
        high = np.maximum(high, np.where(left, next_high, last_high))
        following = np.concatenate((symbols[1:], symbols[:1]))
        symbols = np.where(leads, mix(symbols * np.uint64(0x9FB21C651E98DF25) + (following ^ (following >> np.uint64(7)))), symbols)
        stop = np.where(leads, np.concatenate((stop[1:], stop[:1])), stop)
        keep = ~follows
        symbols, start, stop, low, high, doc = symbols[keep], start[keep], stop[keep], low[keep], high[keep], doc[keep]
    return start, stop, low, high


def least_in(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of keys[first:last] for each pair; none may be empty."""
    out, span = np.empty(len(first), keys.dtype), last - first
    level, table = 1, keys
    while len(out) and level <= span.max():
        at = np.flatnonzero((span >= level) & (span < 2 * level))
        out[at] = np.minimum(table[first[at]], table[last[at] - level])
        table = np.minimum(table[: max(0, len(table) - level)], table[level:]) if len(table) > level else table[:0]
        level *= 2
    return out


def word_anchors(hashes: np.ndarray, sizes: np.ndarray, window: int, rounds: int, context: int) -> tuple[np.ndarray, ...]:
    """(name, seg, document, lo, span) of the windows of documents whose word hashes lie end to end.

    A window's anchor is, of the symbols that words of the window alone decide, the one whose
    surroundings hash lowest; a window without such a symbol (inside one long run, say) is its own.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    starts = np.flatnonzero(ends[doc] - np.arange(len(doc)) >= window)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    prefix = Prefix(hashes, POWERS)
    a, b, low, high = recompress(hashes, doc, rounds)
    from_, to = a - context, b + context
    at = np.flatnonzero((low >= from_) & (high <= to) & (from_ >= 0) & (to <= len(hashes)))
    from_, to = from_[at], to[at]
    names = prefix.of(from_, to) ^ mix((b - a)[at].astype(np.uint64))
    bits = max(1, int(len(names)).bit_length())
    keys = (names >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(names), dtype=np.uint64)
    first, last = np.searchsorted(from_, starts), np.searchsorted(to, starts + window, side="right")
    some = last > first
    choice = -1 - np.arange(len(starts))
    choice[some] = (least_in(keys, first[some], last[some]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    run, span = window_runs(choice, starts)
    lo, picked = starts[run], choice[run]
    own = prefix.of(lo, lo + window)
    name = np.where(picked >= 0, names[np.maximum(picked, 0)] if len(names) else own, ~own)
    seg = prefix.of(lo, lo + span + window - 1) ^ mix(span.astype(np.uint64))
    owner = doc[lo]
    return name, seg, owner, lo - (ends - sizes)[owner], span


def hashed_words(text: bytes) -> list[int]:
    return list(map(xxhash.xxh64_intdigest, text.split()))


def summaries_and_anchors(rows: DataFrame, window: int, rounds: int, context: int) -> DataFrame:
    """A row for each row of `rows` (doc_id, text, own, lead) with a null name, the whole text's n_words and
    kept_sha256, and own; and one for each anchor of the leading ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 1 << 20):
            ids = doc_ids(batch)
            words = [t.split() for t in texts]
            sizes = np.array([len(w) for w in words])
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            none = pa.nulls(len(texts), pa.int64())
            short = pa.nulls(len(texts), pa.int32())
            own = batch.column("own")
            names = ["name", "seg", "doc_id", "lo", "span", "n_words", "kept_sha256", "own"]
            yield pa.RecordBatch.from_arrays([none, none, ids, short, short, pa.array(sizes, pa.int64()), pa.array(sha, pa.string()), own], names)
            known = np.array([i and w for i, w in zip(ids.is_valid().to_pylist(), batch.column("lead").to_pylist())], bool)
            hashes = np.array([xxhash.xxh64_intdigest(w) for ws in words for w in ws], np.uint64)
            name, seg, owner, lo, span = word_anchors(hashes, sizes, window, rounds, context)
            use = known[owner]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name[use].view(np.int64)), pa.array(seg[use].view(np.int64)), ids.take(pa.array(owner[use])),
                    pa.array(lo[use].astype(np.int32)), pa.array(span[use].astype(np.int32)),
                    pa.nulls(int(use.sum()), pa.int64()), pa.nulls(int(use.sum()), pa.string()), pa.nulls(int(use.sum()), pa.int64()),
                ],
                names,
            )

    return rows.mapInArrow(run, ANCHORS + ", n_words long, kept_sha256 string, own long")


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, context: int = CONTEXT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of `docs`.

    Words are runs of bytes other than ASCII white space. A word goes if a window of `window` words
    that covers it starts anywhere else as well, in the same document or another; all such places
    lose it. Windows are judged on the input. `kept` holds the words left, joined by one space, and is
    null where nothing was removed. Null, empty and short texts lose nothing. A row with a null
    doc_id is summed up but neither loses nor causes a removal. Rows equal in doc_id and text are one
    document and come out alike; different texts under one doc_id are documents of their own. Extra
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "recompress")
    keyed, key, lead = with_row_keys(keyed_texts(docs), "recompress_rows")
    rows = keyed.select(F.col(key).alias("doc_id"), "text", F.col("doc_id").alias("own"), F.col(lead).alias("lead"))
    both, _ = scratch.write(summaries_and_anchors(rows, window, rounds, context), "anchors")
    repeats = Repeats(both.filter("name is not null").select("name", "seg", "doc_id", "lo", "span"), "recompress")
    texts = repeats.texts(rows.filter("lead"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slice_texts in text_slices(batches, 1 << 20):
            for doc, text, need in zip(batch.column(0).to_pylist(), slice_texts, batch.column(2).to_pylist()):
                hashes = np.array(hashed_words(text), np.uint64)
                starts = np.concatenate([np.arange(x["lo"], x["lo"] + x["span"]) for x in need])
                starts = starts[starts + window <= len(hashes)]
                h1 = Prefix(hashes, POWERS).of(starts, starts + window)
                h2 = Prefix(hashes, OTHER_POWERS).of(starts, starts + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.full(len(starts), doc)), pa.array(starts.astype(np.int32))],
                    ["h1", "h2", "doc_id", "start"],
                )

    whole = repeats.occurrences.join(repeats.repeated().select("name", "seg"), ["name", "seg"]).select(
        "doc_id", F.col("lo").alias("a"), (F.col("lo") + F.col("span") + window - 1).alias("b")
    )
    # A segment's first place speaks for all of its places: where it repeats, they are gone as a whole.
    single = texts.filter("need is not null").mapInArrow(windows, "h1 long, h2 long, doc_id long, start int")
    parts = equal_windows(single).select("doc_id", F.col("start").alias("a"), (F.col("start") + window).alias("b"))
    cut = cut_out(texts, whole.union(parts), bytes.split, b" ")
    kept = cut.select(F.col("doc_id").alias("_doc"), "n_removed", F.col("kept_sha256").alias("_sha"), "kept")
    return both.filter("name is null").select("own", "doc_id", "n_words", "kept_sha256").join(kept, F.col("doc_id") == F.col("_doc"), "left").select(
        F.col("own").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_sha", "kept_sha256").alias("kept_sha256"), F.col("kept").cast("string").alias("kept"),
    )
