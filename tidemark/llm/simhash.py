"""SimHash near-duplicate detection by tiled exact comparison."""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, doc_ids, join_labels, keyed_texts, text_slices
from tidemark.session import Scratch, materialize

#: Fingerprints in a tile, about: two tiles and one block of comparisons fit in 32 MB.
TILE = 32_768

#: Fingerprint pairs compared in one numpy call, about: what it makes fits in a core's cache.
BLOCK = 1 << 16

#: Joins of candidates with the first of their group before a task takes what is left of it.
ROUNDS = 2


def shingles_of(text: bytes, width: int) -> list[bytes]:
    """The `width` consecutive words of every place; fewer words make one shingle and no words none.

    Letters A-Z are lower-cased, words are runs of bytes other than ASCII white space.
    """
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    count = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: count - 1] + 1)).tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    return [line[a:b] for a, b in zip(starts, stops)]


def fingerprint(shingles: Collection[bytes], seeds: range) -> list[int]:
    """One unsigned 64-bit word for each seed: a bit is set if it is set in over half the shingle hashes,
    repeats included; no shingles make zero."""
    count = len(shingles)
    if not count:
        return [0] * len(seeds)
    out = []
    for seed in seeds:
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], ">u8")
        ones = np.zeros(64, np.int64)
        for lo in range(0, count, 1 << 16):
            ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, width: int = 4, bits: int = 64, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row, fp an array of bits/64 signed longs."""
    seeds = range(seed, seed + bits // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            words = np.array([fingerprint(shingles_of(t, width), seeds) for t in texts], np.uint64).view(np.int64)
            fps = pa.ListArray.from_arrays(
                pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(seeds)), pa.array(words.ravel())
            )
            yield pa.RecordBatch.from_arrays([doc_ids(batch), fps], ["doc_id", "fp"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, fp array<long>")


def count_windows(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of `a` the range of rows of `b` whose population count is within `radius` of its own."""
    ones_a = np.bitwise_count(a).sum(0, dtype=np.int64)
    ones_b = np.bitwise_count(b).sum(0, dtype=np.int64)
    return np.searchsorted(ones_b, ones_a - radius), np.searchsorted(ones_b, ones_a + radius, side="right")


def size_windows(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For every size in `a` the range of `b` that sets of this similarity can have; both are sorted."""
    slack = 1e-9 * (a + 1)
    return np.searchsorted(b, similarity * a - slack), np.searchsorted(b, a / similarity + slack, side="right")


def links_between(
    a: np.ndarray, b: np.ndarray, radius: int, half: int | None = None, windows: tuple[np.ndarray, np.ndarray] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in a, j in b) of rows within `radius` bits; both are words x rows.

    `windows` holds, for every row of `a`, the range of rows of `b` it is compared with, both ends
    rising; without it both are sorted by population count, which gives them. With `half`, pairs must
    be within that many bits in the first half of the words as well; only those that are have the
    other half compared.
    """
    whole = len(a) if half is None else len(a) // 2
    begins, ends = count_windows(a, b, radius) if windows is None else windows
    # Reused by every block: fresh ones of this size would be mapped and cleared each time.
    room = max(BLOCK, b.shape[1])
    xors, counts, sums = np.empty(room, np.uint64), np.empty(room, np.uint8), np.empty(room, np.uint8 if whole < 4 else np.uint16)
    hi = 0
    while (lo := hi) < a.shape[1]:
        first = int(begins[lo])
        hi = min(a.shape[1], lo + max(1, BLOCK // max(1, int(ends[lo]) - first)))
        while hi - lo > 1 and (hi - lo) * (int(ends[hi - 1]) - first) > room:
            hi = lo + (hi - lo) // 2
        last = int(ends[hi - 1])
        if first >= last:
            continue
        shape = (hi - lo, last - first)
        cells = shape[0] * shape[1]
        xor, count, apart = (x[:cells].reshape(shape) for x in (xors, counts, sums))
        for k in range(whole):
            np.bitwise_xor(a[k, lo:hi, None], b[k, None, first:last], out=xor)
            np.bitwise_count(xor, out=count)
            if k:
                np.add(apart, count, out=apart)
            else:
                apart[...] = count
        near = apart <= (radius if half is None else half)
        if near.any():
            i, j = np.divmod(np.flatnonzero(near), shape[1])
            i, j = i + lo, j + first
            if half is not None:
                close = np.bitwise_count(a[:, i] ^ b[:, j]).sum(0, dtype=np.int64) <= radius
                i, j = i[close], j[close]
            yield i, j


def tile_links(
    members: list[pa.ListScalar], words: int, radius: int, half: int | None = None, similarity: float | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The links of a tile pair (or of one tile with itself) as a spanning star of each linked set."""
    parts, nodes, sizes = [], [], []
    for m in members:
        flat = m.values
        fp = flat.field("fp").flatten().to_numpy().view(np.uint64).reshape(-1, words).T
        by = np.bitwise_count(fp).sum(0, dtype=np.int64) if similarity is None else flat.field("size").to_numpy()
        order = np.argsort(by, kind="stable")
        parts.append(np.ascontiguousarray(fp[:, order]))
        nodes.append(flat.field("node").to_numpy()[order])
        sizes.append(by[order])
    shift = 0 if len(parts) == 1 else len(nodes[0])
    labels = np.arange(sum(map(len, nodes)))
    if similarity is None:
        begins, ends = count_windows(parts[0], parts[-1], radius)
    else:
        begins, ends = size_windows(sizes[0], sizes[-1], similarity)
    if len(parts) == 1:  # each pair once
        begins = np.maximum(begins, np.arange(len(begins)))
    for i, j in links_between(parts[0], parts[-1], radius, half, (begins, ends)):
        join_labels(labels, i, j + shift)
    every = np.concatenate(nodes)
    tied = labels != np.arange(len(labels))
    return every[tied], every[labels[tied]]


def near_groups(
    prints: DataFrame, bits: int = 64, radius: int = 4, tile: int = TILE, half: int | None = None, similarity: float | None = None
) -> DataFrame:
    """(node, root) of the fingerprints linked to another one at `radius` bits or fewer (and `half` in their first half).

    `prints` has (fp, node), each fingerprint once. Fingerprints are dealt by population count, and
    a count's fingerprints by hash, into tiles of about `tile`; tiles whose counts differ by more
    than the radius are never paired. A task compares one pair of tiles exactly, in blocks, and
    returns a spanning star for each linked set it found: no link is lost and a group of n near
    copies makes fewer than 2n rows a tile pair, not n * n. The number of tile pairs is quadratic in
    the number of different fingerprints, as the method is.

    With `similarity`, `prints` also has the `size` of each set, 1 or more: sets of that Jaccard
    similarity have sizes of that ratio or nearer, so tiles are bands of sizes and only sizes within
    the ratio are compared. Unlike population counts at a wide radius, sizes tell most pairs apart.
    """
    words = bits // 64
    if similarity is None:
        band, span = F.aggregate("fp", F.lit(0), lambda s, x: s + F.bit_count(x)), radius
    else:
        # A little wider than the ratio, so that rounding cannot put a pair two bands apart.
        band, span = F.floor(F.log("size") / (-1.000001 * math.log(similarity))).cast("int"), 1
    counted = prints.withColumn("ones", band)
    sizes = counted.groupBy("ones").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("fan"))
    dealt = counted.join(sizes, "ones").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("fan")).cast("int"))
    tiles = materialize(
        dealt.groupBy("ones", "part").agg(F.collect_list(F.struct(*prints.columns)).alias("members")), "tiles"
    )
    here = tiles.select("ones", "part")
    near = here.withColumn("near", F.explode(F.sequence(F.col("ones"), F.col("ones") + span)))
    there = here.select(F.col("ones").alias("near"), F.col("part").alias("other"))
    pairs = near.join(there, "near").filter("near > ones or other >= part")
    sides = pairs.select(
        "ones", "part", "near", "other",
        F.explode(F.expr(
            "if(ones = near and part = other, array(named_struct('side', 0, 'o', ones, 'p', part)),"
            " array(named_struct('side', 0, 'o', ones, 'p', part), named_struct('side', 1, 'o', near, 'p', other)))"
        )).alias("s"),
    )
    held = tiles.select(F.col("ones").alias("o"), F.col("part").alias("p"), "members")
    work = sides.select("ones", "part", "near", "other", "s.*").join(held, ["o", "p"])

    def compare(table: pa.Table) -> pa.Table:
        a, b = tile_links(list(table.column("members")), words, radius, half, similarity)
        return pa.table({"a": a, "b": b}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    links = work.groupBy("ones", "part", "near", "other").applyInArrow(compare, "a long, b long")
    return components(materialize(links, "links"), "near")


def near_dedup_groups(docs: DataFrame, width: int = 4, bits: int = 64, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`; component_id is the smallest doc_id reachable.

    Fingerprints of `bits` bits link at `radius` differing bits or fewer. Null and empty texts have
    fingerprint zero and link like any other. A null doc_id is fingerprinted, takes part in nothing
    and has a null component_id. Repeated rows give repeated rows. Extra columns are ignored.
    """
    prints = materialize(fingerprints(docs, width, bits), "prints")
    nodes = materialize(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = near_groups(nodes, bits, radius, tile)
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def radius_for(similarity: float, bits: int) -> int:
    """Bits within which shingle sets of this Jaccard similarity differ: the mean and four deviations more.

    Sets of one size differ most. Very small ones differ in up to 3 bits of 16 at 0.8 (five shingles
    and four of them), more than the angle says.
    """
    share = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, 15 / 16 * (1 - similarity))
    return math.floor(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def hashes_of(shingles: Collection[bytes]) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 7) for s in shingles], np.uint64).view(np.int64))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The hashes of the different shingles, sorted."""
    return hashes_of(set(shingles_of(text, width)))


def set_hash(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def set_prints(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """(doc_id, label, size, fp) for every row: a hash, the size and the fingerprint of its shingle set."""
    seeds = range(42, 42 + bits // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            labels, sizes, words = [], [], []
            for t in texts:
                shingles = set(shingles_of(t, width))
                held = hashes_of(shingles)
                labels.append(set_hash(held))
                sizes.append(len(held))
                words.append(fingerprint(shingles, seeds))
            flat = np.array(words, np.uint64).view(np.int64).ravel()
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(seeds)), pa.array(flat))
            label = pa.array(np.array(labels, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([doc_ids(batch), label, pa.array(sizes, pa.int64()), fps], ["doc_id", "label", "size", "fp"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, label long, size long, fp array<long>")


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, label, held) for every row, held the hashes of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            sets = [shingle_hashes(t, width) for t in texts]
            label = pa.array(np.array([set_hash(h) for h in sets], np.uint64).view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(h) for h in sets]))).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([doc_ids(batch), label, held], ["doc_id", "label", "held"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, label long, held array<long>")


def covered(table: pa.Table, similarity: float) -> pa.Table:
    """The labels of a group that are similar to one before them (by doc) which is not itself such a one."""
    order = pc.sort_indices(table, sort_keys=[("doc", "ascending"), ("label", "ascending")])
    table = table.take(order)
    kept_sizes: list[int] = []
    posted: dict[int, list[int]] = {}
    out = []
    for label, held in zip(table.column("label").to_pylist(), table.column("held")):
        hashes = held.values.to_pylist()
        met = np.array([k for h in hashes for k in posted.get(h, ())], np.int64)
        common = np.bincount(met, minlength=len(kept_sizes))
        union = np.array(kept_sizes, np.int64) + len(hashes) - common
        if (common >= similarity * union - 1e-9).any():
            out.append(label)
            continue
        for h in hashes:
            posted.setdefault(h, []).append(len(kept_sizes))
        kept_sizes.append(len(hashes))
    return pa.table({"label": pa.array(out, pa.int64())})


def similar_labels(sets: DataFrame, similarity: float, rounds: int = ROUNDS) -> DataFrame:
    """The labels of `sets` (root, doc, label, held) that are similar to a kept one with the same root.

    Labels are taken in order of doc; one that is not similar to any kept one is kept. The first of
    every root is kept, so all others are compared with it by a join, which adaptive execution can
    split; what it does not cover goes on to the next round, and after `rounds` of them a task takes
    what is left of a root.
    """
    scratch = Scratch(sets.sparkSession, "similar")
    left, gone = sets, []
    for n in range(rounds):
        first = left.groupBy("root").agg(F.min_by("held", F.struct("doc", "label")).alias("lead"), F.min(F.struct("doc", "label")).alias("at"))
        met = left.join(first, "root").filter(F.struct("doc", "label") != F.col("at"))
        common = F.size(F.array_intersect("held", "lead"))
        near = common >= similarity * (F.size("held") + F.size("lead") - common) - F.lit(1e-9)
        judged, count = scratch.write(met.select("root", "doc", "label", "held", near.alias("near")), f"r{n}")
        gone.append(judged.filter("near").select("label"))
        left = judged.filter("not near").drop("near")
        if not count:
            break
    out = left.groupBy("root").applyInArrow(lambda t: covered(t, similarity), "label long")
    for g in gone:
        out = out.union(g)
    return out


def near_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, bits: int = 256) -> DataFrame:
    """`docs` without the documents whose set of shingles has a Jaccard similarity of `similarity` or
    more with that of a document that stays; of two the one with the smaller doc_id stays.

    Fingerprints of the sets give the candidates, at a radius that leaves out fewer than one pair in
    ten thousand at that similarity; whether a pair is similar is then counted on the sets themselves,
    so no document goes for its fingerprint alone. Texts without words are copies of each other. Rows
    that repeat a kept doc_id are that document and stay; rows with a null doc_id all stay.
    """
    prints = materialize(set_prints(docs, width, bits).filter("doc_id is not null"), "prints")
    nodes = materialize(prints.groupBy("label").agg(F.min("doc_id").alias("doc"), F.first("fp").alias("fp"), F.first("size").alias("size")), "nodes")
    search = nodes.filter("size > 0").select("fp", F.col("label").alias("node"), "size")
    roots = near_groups(search, bits, radius_for(similarity, bits), half=radius_for(similarity, bits // 2), similarity=similarity)
    members = materialize(roots.join(nodes, roots["node"] == nodes["label"]).select("root", "doc", "label"), "members")
    texts = docs.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows = set_rows(texts, width).withColumnRenamed("doc_id", "doc").dropDuplicates(["doc", "label"])
    gone = similar_labels(materialize(members.join(rows, ["doc", "label"]), "sets"), similarity).withColumn("near", F.lit(True))
    judged = prints.join(nodes.select("label", "doc"), "label").join(materialize(gone, "gone"), "label", "left")
    stays = (F.col("doc") == F.col("doc_id")) & F.col("near").isNull()
    dropped = judged.groupBy("doc_id").agg(F.bool_or(stays).alias("stays")).filter("not stays").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
