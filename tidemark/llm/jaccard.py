"""Similarity join of shingle sets: subsets are enumerated for small sets, inverted lists scanned for large ones."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components, doc_ids, keyed_texts, text_slices
from tidemark.llm.importance import pieces
from tidemark.session import Scratch, materialize

#: Leading bits of a shingle's hash that its frequency class is counted by.
CLASS_BITS = 16

#: Sets larger than this are never enumerated: their subsets would be thousands.
MOST_SMALL = 16

#: Subsets in a batch, about.
SUBSETS = 1 << 16

#: Members of an inverted list that one key holds, about; longer lists are dealt over several keys.
LIST = 10_000

#: Rounds in which each list compares its members with one of them before pairs are listed.
ROUNDS = 3

#: A round that joins fewer than one in so many of its pairs is the last of these.
WORTH = 10

#: Lists of a set before a given one by which a pair that an earlier list has is known.
RECENT = 8

#: Turns the order of signed longs into that of unsigned ones, and back.
LOWEST = -(1 << 63)

#: Bits of the filter that spares the texts of documents without a candidate a shuffle.
FILTER_BITS = 20

#: Different sets that a task remembers to have posted.
POSTED = 1 << 20

#: Bytes whose words are hashed at once, about: some ten times as much memory.
PIECE = 4 << 20

#: A-Z in lower case, white space as blanks.
FOLDED = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))

HELD = "label long, held array<long>"

#: Words of 64 parity bits kept of each set: those that go through the lists, and those that pairs are judged by.
#: Both are powers of 2. Larger sets than WIDE has bits have a third parity, of a bit or more for each shingle.
PARITY, WIDE = 4, 16


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap of sets of sizes a and b at which 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(size: int, percent: int) -> range:
    """Sizes of the sets that a set of `size` can link with."""
    return range(-(-percent * size // 100), size * 100 // percent + 1)


def prefix(size: int, percent: int) -> int:
    """So many first shingles of a set, in any fixed order, hold one that each of its partners has among its own first."""
    return size - needed(size, partner_sizes(size, percent)[0], percent) + 1 if size else 0


def scrambled(values: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that leaves no pattern."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def word_hashes(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The place and the hash of each word of `line`, whose words stand between blanks.

    A hash is the sum of the word's bytes, each times a random factor of its place in the word, so all
    words of a piece are hashed at once.
    """
    places, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for piece in pieces(line, PIECE):
        data = np.frombuffer(piece, np.uint8)
        letter = data != 32
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        if len(starts):
            first = np.cumsum(lengths) - lengths
            inside = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
            factors = scrambled(np.arange(1, lengths.max() + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            terms = factors[inside]
            terms *= data[letter].astype(np.uint64) + np.uint64(1)
            hashes.append(scrambled(np.add.reduceat(terms, first)))
            places.append(starts + at)
        at += len(piece)
    return np.concatenate(places), np.concatenate(hashes)


def run_hashes(words: np.ndarray, run: int) -> np.ndarray:
    """The hash of each run of `run` words."""
    last = len(words) - run + 1
    out = np.full(max(0, last), run, np.uint64)
    for k in range(run if last > 0 else 0):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out += words[k : k + last]
    return scrambled(out)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of `width` words; fewer words make one run, no words none."""
    places, words = word_hashes(b" ".join(texts).translate(FOLDED))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    first = np.searchsorted(places, starts).tolist() + [len(places)]
    runs = run_hashes(words, width)
    return [
        np.unique(runs[a : b - width + 1] if b - a >= width else run_hashes(words[a:b], b - a) if b > a else words[:0])
        for a, b in zip(first[:-1], first[1:])
    ]


def parity(held: np.ndarray, words: int = PARITY) -> np.ndarray:
    """Whether an odd number of the hashes falls on each of 64 * `words` places.

    Two sets differ in at least as many shingles as their parities do in bits.
    """
    odd = np.bincount((held >> np.uint64(8)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(">u8").astype(np.uint64).view(np.int64)


def long_parity(held: np.ndarray) -> np.ndarray:
    """The parities of a large set on the least power of 2 of places that is not below its size; none of another.

    A power of 2 lets one of twice the places be folded: the places of each half share a bit.
    """
    if len(held) <= 64 * WIDE:
        return np.zeros(0, np.int64)
    return parity(held, 1 << (-(-len(held) // 64) - 1).bit_length())


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def list_array(parts: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document, and after them a task's counts of the frequency classes (kind 1: label is the class, size the count).

    label is a hash of the set, odd, wide and long its parities, held its shingles if it is small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CLASS_BITS, np.int64)
        names = ["kind", "doc_id", "label", "size", "odd", "wide", "long", "held"]
        for batch, texts in text_slices(batches):
            sets = shingle_sets(texts, width)
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - CLASS_BITS)).astype(np.int64), minlength=len(counts))
            small = [signed(s) if len(s) <= MOST_SMALL else np.zeros(0, np.int64) for s in sets]
            labels = np.array([xxhash.xxh64_intdigest(s.tobytes(), 5) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(sets), np.int32)), doc_ids(batch), pa.array(signed(labels)), pa.array([len(s) for s in sets], pa.int64()),
                    list_array([parity(s) for s in sets], np.int64), list_array([parity(s, WIDE) for s in sets], np.int64),
                    list_array([long_parity(s) for s in sets], np.int64), list_array(small, np.int64),
                ],
                names,
            )
        seen = np.flatnonzero(counts)
        none = pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(seen), np.int32)), none[0], pa.array(seen), pa.array(counts[seen]), *[none[1]] * 4], names)

    return keyed_texts(docs).mapInArrow(run, "kind int, doc_id long, label long, size long, odd array<long>, wide array<long>, long array<long>, held array<long>")


def class_ranks(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each frequency class, rarest first, and by rank over how many keys a list of its shingles is dealt.

    At most 65,536 counts come to the driver and go to the tasks. Counts that every class has from rare
    shingles alone say nothing of a frequent one, so twice the mean is taken off them first.
    """
    counts = np.zeros(1 << CLASS_BITS, np.int64)
    for r in counted.groupBy("label").agg(F.sum("size").alias("n")).collect():
        counts[r.label] = r.n
    ranks = np.empty(len(counts), np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    fan = np.empty(len(counts), np.int64)
    fan[ranks.astype(np.int64)] = 1 + np.maximum(0, counts - 2 * int(counts.mean())) // LIST
    return ranks, fan


def postings(docs: DataFrame, width: int, percent: int, ranks: np.ndarray, fan: np.ndarray) -> DataFrame:
    """(token, part, fan, label, at): the first shingles of each set, rare classes first; at = size and place in one long.

    token is the shingle's hash with its class replaced by the class's rank, so tokens are in the global order. A
    task posts equal sets once.
    """
    low = np.uint64(64 - CLASS_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posted = set()
        for _, texts in text_slices(batches):
            tokens, labels, places = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
            for held in shingle_sets(texts, width):
                label = xxhash.xxh64_intdigest(held.tobytes(), 5)
                if not len(held) or label in posted:
                    continue
                if len(posted) >= POSTED:
                    posted.clear()
                posted.add(label)
                count = prefix(len(held), percent)
                ordered = (ranks[(held >> low).astype(np.int64)] << low) | (held & np.uint64((1 << int(low)) - 1))
                if count < len(ordered):
                    ordered = np.partition(ordered, count - 1)[:count]
                ordered.sort()
                tokens.append(ordered)
                labels.append(label)
                places.append((len(held) << 32) + np.arange(1, count + 1))
            token = np.concatenate(tokens)
            label = np.repeat(np.array(labels, np.uint64), [len(p) for p in places[1:]])
            keys = fan[(token >> low).astype(np.int64)]
            part = (label >> np.uint64(7)).astype(np.int64) % keys
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(token)), pa.array(part.astype(np.int32)), pa.array(keys.astype(np.int32)), pa.array(signed(label)), pa.array(np.concatenate(places))],
                ["token", "part", "fan", "label", "at"],
            )

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, part int, fan int, label long, at long")


def shared_lists(posted: DataFrame) -> DataFrame:
    """(token, part, fan, label, size, place, n) of the postings whose list has different sets; n is the length of the part.

    A part holds LIST sets or so, or what a class has of rare shingles; lists of several parts stay whatever a part holds.
    """
    each = Window.partitionBy("token", "part")
    dealt = posted.repartition(F.col("token"), F.col("part")).withColumns(
        {"_low": F.min("label").over(each), "_high": F.max("label").over(each), "n": F.count(F.lit(1)).over(each)}
    )
    kept = dealt.filter("_low <> _high or fan > 1")
    return kept.select(
        "token", "part", "fan", "label", F.shiftright("at", 32).alias("size"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("place"), "n"
    ).dropDuplicates(["token", "part", "label"])


def distinct_lists(lists: DataFrame) -> DataFrame:
    """Of the lists that have the same members the first in the order of shingles, which is that of unsigned tokens; none of one member.

    The first shingle that two sets have in common is the first one of all that its members have in common, so every
    pair keeps the list that it is first found by. Members are compared by their number and two 64-bit hashes.
    """
    members = [F.count(F.lit(1)).alias("_members"), *(F.bit_xor(F.xxhash64("label", F.lit(k))).alias(f"_hash{k}") for k in (1, 2))]
    told = lists.groupBy("token").agg(*members).filter("_members > 1")
    first = F.min(F.col("token").bitwiseXOR(F.lit(LOWEST))).bitwiseXOR(F.lit(LOWEST)).alias("token")
    return lists.join(told.groupBy("_members", "_hash1", "_hash2").agg(first).select("token"), "token", "left_semi")


def enumerated(size: int, below: int, percent: int) -> int:
    """How many subsets a set of `size` has for its partners smaller than `below`."""
    return sum(math.comb(size, needed(size, s, percent)) for s in partner_sizes(size, percent) if s < below)


def boundary(sets: DataFrame, lists: DataFrame, percent: int) -> int:
    """The size from which sets are scanned for: enumerating all smaller ones and scanning the rest costs least.

    A set costs a row for each subset, or the lengths of its lists. Both are summed by size, for at most
    MOST_SMALL sizes; larger sets are scanned in any case.
    """
    small = F.col("size") <= MOST_SMALL
    count = {r["size"]: r.n for r in sets.filter(small).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    scan = {r["size"]: r.n for r in lists.filter(small).groupBy("size").agg(F.sum("n").alias("n")).collect()}

    def cost(below: int) -> int:
        light = sum(n * enumerated(s, below, percent) for s, n in count.items() if s < below)
        return light + sum(n for s, n in scan.items() if s >= below)

    return min(range(1, MOST_SMALL + 2), key=cost)


def subset_links(sets: DataFrame, below: int, percent: int) -> DataFrame:
    """Links (a, b) between sets smaller than `below`: those of two sizes that share a subset as large as their overlap must be.

    All sets of one key link with each other (or, of two sizes, each of one with each of the other), so
    links with the smallest label join the same sets as all pairs would.
    """

    names = ["key", "label", "size", "same"]

    def table(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        held = np.array(rows, np.int64).reshape(-1, len(names))
        return pa.RecordBatch.from_arrays([pa.array(held[:, k]) for k in range(len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for label, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = sorted(held)
                for other in partner_sizes(len(held), percent):
                    if other < below:
                        pair = min(len(held), other), max(len(held), other)
                        for subset in itertools.combinations(held, needed(*pair, percent)):
                            key = xxhash.xxh64_intdigest(np.array([*pair, *subset], np.int64).tobytes(), 3)
                            rows.append((key - (key >> 63 << 64), label, len(held), int(pair[0] == pair[1])))
                if len(rows) > SUBSETS:
                    yield table(rows)
                    rows = []
        yield table(rows)

    small = sets.filter((F.col("size") > 0) & (F.col("size") < below)).select("label", "held")
    rows = materialize(small.mapInArrow(run, "key long, label long, size long, same long"), "subsets")
    met = rows.groupBy("key").agg(F.min("label").alias("b"), F.max("label").alias("_high"), F.min("size").alias("_less"), F.max("size").alias("_more"), F.max("same").alias("_same"))
    both = met.filter("b <> _high and (_same = 1 or _less <> _more)").select("key", "b")
    return rows.join(both, "key").filter("label <> b").select(F.col("label").alias("a"), "b").distinct()


def needed_column(a: Column, b: Column, percent: int) -> Column:
    return F.ceil((a + b) * percent / (100 + percent))


def most_apart(a: str, b: str, percent: int) -> Column:
    """So many shingles may stand in only one of two linked sets of these sizes."""
    sa, sb = F.col(f"{a}.size"), F.col(f"{b}.size")
    return sa + sb - 2 * needed_column(sa, sb, percent)


def may_link(a: str, b: str, percent: int, bits: str = "odd", words: int = PARITY) -> Column:
    """Whether sizes and parities of the rows `a` and `b` allow a link."""
    sa, sb = F.col(f"{a}.size"), F.col(f"{b}.size")
    apart = F.lit(0)
    for k in range(words):
        apart = apart + F.bit_count(F.col(f"{a}.{bits}")[k].bitwiseXOR(F.col(f"{b}.{bits}")[k]))
    return (sa * 100 >= sb * percent) & (sb * 100 >= sa * percent) & (apart <= most_apart(a, b, percent))


def may_link_long(a: str, b: str, percent: int) -> Column:
    """Whether the long parities of the rows `a` and `b` allow a link; they do where one has none.

    Of the sizes of linked sets the larger has the same places or, over a power of 2, twice as many or more.
    """
    places = F.least(F.size(f"{a}.long"), F.size(f"{b}.long"))

    def folded(side: str) -> Column:
        bits = F.col(f"{side}.long")
        return F.transform(
            F.sequence(F.lit(0), places - 1),
            lambda i: F.aggregate(
                F.sequence(i, F.size(bits) - 1, places), F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(bits, k))
            ),
        )

    met = F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(met, F.lit(0), lambda n, x: n + x)
    return F.when(places > 0, apart <= most_apart(a, b, percent)).otherwise(True)


def in_reach(a: str, b: str, percent: int) -> Column:
    """Whether two sets whose first common shingle stands at these places can still have enough of them in common."""
    sa, sb = F.col(f"{a}.size"), F.col(f"{b}.size")
    spare = needed_column(sa, sb, percent) - 1
    return (F.col(f"{a}.place") + spare <= sa) & (F.col(f"{b}.place") + spare <= sb)


def chosen_pairs(lists: DataFrame, sets: DataFrame, named: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs (a, b) of each member of a part with the member that hashes lowest, unless a link already joins them."""
    order = F.xxhash64("label", F.lit(seed))
    first = lists.groupBy("token", "part").agg(F.min_by("label", order).alias("b"))
    pairs = lists.select("token", "part", F.col("label").alias("a")).join(first, ["token", "part"]).filter("a <> b").select("a", "b")
    return allowed(pairs, sets, named, percent)


def allowed(pairs: DataFrame, sets: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """The pairs, each once, whose sets may link and are not joined yet."""
    known = sets.join(named, "label").select("label", "size", "wide", "root")
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = once.join(known.alias("x"), F.col("a") == F.col("x.label")).join(known.alias("y"), F.col("b") == F.col("y.label"))
    near = sides.filter((F.col("x.root") != F.col("y.root")) & may_link("x", "y", percent, "wide", WIDE)).select("a", "b")
    large = sets.filter(F.size("long") > 0).select("label", "size", "long")
    met = near.join(large.alias("x"), F.col("a") == F.col("x.label"), "left").join(large.alias("y"), F.col("b") == F.col("y.label"), "left")
    either = F.col("x.label").isNull() | F.col("y.label").isNull()
    return met.filter(F.when(either, True).otherwise(may_link_long("x", "y", percent))).select("a", "b")


def listed_pairs(lists: DataFrame, sets: DataFrame, named: DataFrame, below: int, percent: int) -> DataFrame:
    """All pairs (a, b) that share a list, may link and are not joined yet; pairs of two small sets are left to their subsets.

    A list of several parts compares each part with itself and each other one under a key of its own. A pair is
    listed where it is first found: not where one of the last RECENT lists before this one has both sets too.
    """
    earlier = Window.partitionBy("label").orderBy("place").rowsBetween(-RECENT, -1)
    recent = lists.withColumn("before", F.collect_list("token").over(earlier))
    held = recent.join(sets.select("label", "odd"), "label").join(named, "label")
    left = held.withColumn("_other", F.explode(F.sequence("part", F.col("fan") - 1))).withColumnRenamed("part", "_part")
    right = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("part")))).withColumnRenamed("part", "_other")
    x, y = left.alias("x"), right.alias("y")
    keys = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("token", "_part", "_other")]
    ordered = (F.col("x._part") < F.col("y._other")) | (F.col("x.label") < F.col("y.label"))
    rest = ordered & (F.col("x.root") != F.col("y.root")) & in_reach("x", "y", percent) & may_link("x", "y", percent)
    large = (F.col("x.size") >= below) | (F.col("y.size") >= below)
    pairs = x.join(y, [*keys, rest & large & ~F.arrays_overlap("x.before", "y.before")])
    return allowed(pairs.select(F.col("x.label").alias("a"), F.col("y.label").alias("b")), sets, named, percent)


def wanted_sets(docs: DataFrame, sets: DataFrame, pairs: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """(label, held) of every set in `pairs` that is not in `held` yet, once: its sorted shingles, from the whole text.

    Documents are first told by a hash of 20 bits, at most a million of which go to the tasks (8 MB), so
    that few other texts are read through; the join on the label sorts out the rest.
    """
    labels = pairs.select(F.explode(F.array("a", "b")).alias("label")).distinct().join(held, "label", "left_anti")
    wanted = materialize(labels.join(sets.select("label", "doc"), "label"), "wanted")

    def place(doc: str) -> Column:
        return F.pmod(F.xxhash64(doc), F.lit(1 << FILTER_BITS)).alias("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches):
            found = shingle_sets(texts, width)
            label = np.array([xxhash.xxh64_intdigest(h.tobytes(), 5) for h in found], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(label)), list_array([np.sort(signed(h)) for h in found], np.int64)], ["label", "held"])

    places = F.broadcast(wanted.select(place("doc")).distinct())
    few = docs.filter("doc_id is not null").select(place("doc_id"), F.col("text").cast("string").alias("text")).join(places, "place", "left_semi")
    rows = few.select("text").mapInArrow(run, "label long, held array<long>").join(wanted.select("label"), "label", "left_semi")
    return rows.groupBy("label").agg(F.first("held").alias("held"))


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: overlap and union are counted on the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, np.bool_)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                common = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
                keep[k] = 100 * common >= percent * (len(a) + len(b) - common)
            chosen = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], ["a", "b"])

    first = pairs.join(held.select(F.col("label").alias("a"), F.col("held").alias("held_a")), "a")
    both = first.join(held.select(F.col("label").alias("b"), F.col("held").alias("held_b")), "b")
    return both.select("a", "b", "held_a", "held_b").mapInArrow(run, "a long, b long")


def roots_of(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(label, root) of every set."""
    found = components(links, "jaccard")
    return materialize(
        sets.select("label").join(found, F.col("label") == F.col("node"), "left").select("label", F.coalesce("root", "label").alias("root")), "roots"
    )


def mixed(lists: DataFrame, named: DataFrame) -> DataFrame:
    """The lists whose members are not all joined yet."""
    held = lists.join(named, "label")
    apart = held.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("token")
    return lists.join(apart, "token", "left_semi")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    Sets of distinct shingles link at 100 * intersection >= percent * union; component_id is the smallest
    doc_id that links reach. Sets with fewer than `width` words hold the whole sequence as one shingle; null, empty
    and blank texts hold none and link with nothing, not even each other. A row with a null doc_id gets its
    n_shingles, links with nothing and has a null component_id. Rows that repeat a doc_id are documents of their own. Extra columns are ignored.

    Equal sets are one set. Every set posts its first shingles, in an order that puts frequent ones last.
    Of sets below a size chosen by cost, subsets are joined; every other link shares an inverted list. Lists of the same
    members are one list. Lists are scanned in
    rounds against one member each, which joins a group of near copies by as many comparisons as it has
    members; lists whose members are all joined by then are done, and of the others every pair not joined is compared that
    sizes, places and parities allow. Shingles and sets are told apart by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    sketched = materialize(sketches(docs, width), "sketches")
    rows = sketched.filter("kind = 0")
    ranks, fan = class_ranks(sketched.filter("kind = 1"))
    grouped = rows.filter("size > 0 and doc_id is not null").groupBy("label").agg(
        F.min("doc_id").alias("doc"), F.first("size").alias("size"), F.first("odd").alias("odd"), F.first("wide").alias("wide"), F.first("long").alias("long"),
        F.first("held").alias("held"),
    )
    sets, _ = scratch.write(grouped, "sets")
    every, _ = scratch.write(shared_lists(postings(docs.filter("doc_id is not null"), width, percent, ranks, fan)), "every")
    lists, shared = scratch.write(distinct_lists(every), "lists")
    below = boundary(sets, lists, percent)
    links, _ = scratch.write(subset_links(sets, below, percent), "subset_links")
    named = roots_of(sets, links)
    held, names, listing = docs.sparkSession.createDataFrame([], HELD), [], rounds == 0
    for n in itertools.count():
        if n:
            lists, shared = scratch.write(mixed(lists, named), f"lists{n}")
        if not shared:
            break
        found = listed_pairs(lists, sets, named, below, percent) if listing else chosen_pairs(lists, sets, named, percent, n)
        pairs, count = scratch.write(found, f"pairs{n}")
        scratch.write(wanted_sets(docs, sets, pairs, held, width), f"held{n}")
        names.append(f"held{n}")
        held = scratch.read_all(names, held.schema)
        new, more = scratch.write(verified(pairs, held, percent), f"links{n}")
        links, _ = scratch.write(links.union(new), f"all{n}")
        if more:
            named = roots_of(sets, links)
        if listing:
            break
        listing = n + 1 >= rounds or more * WORTH < count
    member = sets.select("label", "doc").join(named, "label")
    least = member.join(member.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select("label", "component_id")
    found = rows.join(least, "label", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
