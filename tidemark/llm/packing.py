"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed_texts, text_slices
from tidemark.session import Scratch, materialize

#: Permitted sequence lengths, in words.
CAPACITIES = (256, 512, 1024, 2048)

#: Pieces packed together by one task, about.
GROUP = 50_000

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sequence_cost(capacity: int) -> float:
    """What a sequence of this length costs to train on: its words, attention, and a fixed overhead."""
    return capacity * (1 + capacity / 65_536) + 32


def best_fit(
    lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, its offset there, capacity of each bin); no length may exceed the largest capacity.

    Longest first, each piece goes to the open bin it leaves the least space in. If none has room, a
    bin opens at the size whose cost is least for a word it can expect to hold: the piece, and as much
    of the shorter pieces still to come as would fit beside it. At the end each bin shrinks to the
    smallest permitted size that holds its contents.
    """
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    after = np.concatenate((np.cumsum(falling[::-1])[::-1], [0]))
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    by_space: dict[int, list[int]] = {}
    open_spaces = 0
    for i, length in enumerate(falling.tolist()):
        fitting = open_spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            stack = by_space[space]
            k = stack.pop()
            if not stack:
                open_spaces ^= 1 << space
        else:
            best = None
            for size in sizes:
                if size >= length:
                    first = max(i + 1, int(np.searchsorted(-falling, -(size - length))))
                    holds = max(1, min(size, length + int(after[first])))
                    rate = cost(size) / holds
                    if best is None or rate < best[0]:
                        best = (rate, size)
            space = best[1]
            k = len(used)
            used.append(0)
        where[order[i]], offset[order[i]] = k, used[k]
        used[k] += length
        left = space - length
        by_space.setdefault(left, []).append(k)
        open_spaces |= 1 << left
    fill = np.array(used, np.int64)
    final = np.array(sizes, np.int64)[np.searchsorted(sizes, fill)] if len(fill) else fill
    return where, offset, final


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, n_words, bin_id, bin_offset, capacity, bin_words), one row for each piece.

    A document's words are runs of characters other than ASCII white space. One longer than the largest capacity is cut into
    pieces of that size and a rest, so every word of every document is in exactly one bin. Pieces are
    dealt by hash into groups of about `group` and each group is packed by itself, so no task grows
    with the input and a hot source is spread. A document without words (null, empty, blank) is one
    piece of 0 words in no bin (null bin_id). Rows with a null doc_id or a repeated one are packed like
    any other. Extra columns are ignored.
    """
    return place(keyed_texts(docs), capacities, cost, group, ["doc_id"])


def place(texts: DataFrame, capacities: Sequence[int], cost: Callable[[int], float], group: int, keys: list[str]) -> DataFrame:
    """What pack() returns for `texts` (doc_id, text and the other `keys`), with the keys before the piece;
    pieces are dealt by the last key."""
    largest = max(capacities)
    counted = texts.select(
        *keys, F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("words")
    )
    pieces = counted.select(*keys, "words", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / largest) - 1, F.lit(0)).cast("int"))).alias("piece")).select(
        *keys, "piece",
        (F.col("piece").cast("long") * largest).alias("start"),
        F.least(F.lit(largest), F.col("words") - F.col("piece").cast("long") * largest).cast("long").alias("n_words"),
    )
    held, count = Scratch(texts.sparkSession, "pieces").write(pieces, "t")
    groups = max(1, -(-count // group))
    none = [F.lit(None).cast("long").alias("bin_id"), *(F.lit(0).cast("long").alias(c) for c in ("bin_offset", "capacity", "bin_words"))]
    empty = held.filter("n_words = 0").select(*keys, "piece", "start", "n_words", *none)

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[*((k, "ascending") for k in keys), ("piece", "ascending"), ("n_words", "ascending")])
        table = table.take(order)
        where, offset, final = best_fit(table.column("n_words").to_numpy(), capacities, cost)
        fill = np.bincount(where, table.column("n_words").to_numpy(), len(final)).astype(np.int64)
        base = table.column("deal")[0].as_py() << 32
        out = table.select([*keys, "piece", "start", "n_words"])
        for name, values in (("bin_id", base + where), ("bin_offset", offset), ("capacity", final[where]), ("bin_words", fill[where])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    dealt = held.filter("n_words > 0").withColumn("deal", F.pmod(F.xxhash64(keys[-1], "piece", "n_words"), F.lit(groups)))
    packed = dealt.groupBy("deal").applyInArrow(
        run, ", ".join(f"{k} long" for k in keys) + ", piece int, start long, n_words long, bin_id long, bin_offset long, capacity long, bin_words long"
    )
    return packed.union(empty)


def cut_pieces(text: bytes, largest: int) -> list[str]:
    """The text in runs of `largest` words, each with the white space that follows it; a short text as it is."""
    starts = [m.start() for m in WORD.finditer(text)][::largest]
    bounds = [0, *starts[1:], len(text)]
    return [text[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]


def packed_sequences(
    docs: DataFrame, capacities: Sequence[int] = CAPACITIES, separator: str = "\n\n",
    cost: Callable[[int], float] = sequence_cost, group: int = GROUP,
) -> DataFrame:
    """(bin_id, capacity, n_words, doc_ids, text): every bin as the texts of its pieces, in their order.

    Documents without words are in no bin. `doc_ids` names a document once for each of its pieces. Rows
    are told apart by a number of their own, so those with a null doc_id or a repeated one lose and
    gain nothing.
    """
    largest = max(capacities)
    rows = materialize(keyed_texts(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    placed = place(rows, capacities, cost, group, ["doc_id", "row"]).filter("bin_id is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            cuts = [(d, i, p) for d, t in zip(batch.column(0).to_pylist(), texts) for i, p in enumerate(cut_pieces(t, largest))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in cuts], pa.int64()), pa.array([r[1] for r in cuts], pa.int32()), pa.array([r[2] for r in cuts], pa.string())],
                ["row", "piece", "text"],
            )

    texts = rows.select("row", "text").mapInArrow(cut, "row long, piece int, text string")
    joined = placed.join(texts, ["row", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("bin_offset", "doc_id", "text")))
    return joined.groupBy("bin_id", "capacity", F.col("bin_words").alias("n_words")).agg(parts.alias("parts")).select(
        "bin_id", "capacity", "n_words",
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.array_join(F.transform("parts", lambda p: p["text"]), separator).alias("text"),
    )
