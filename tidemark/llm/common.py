"""What several operators share: batches of whole texts, label joining, and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch, materialize

#: What `documents` keys on; every operator takes it as a bigint.
DOC_ID = "doc_id"


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches with a `text` column into row ranges of about `limit` bytes; null texts read as empty.

    A text longer than `limit` makes a slice of its own and is never cut.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        if not len(ends):
            continue
        cuts = np.flatnonzero(np.diff(ends // limit)) + 1
        bounds = [0, *cuts.tolist(), len(ends)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            yield batch.slice(lo, hi - lo), [t or b"" for t in column.slice(lo, hi - lo).to_pylist()]


def doc_ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index(DOC_ID))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """Just the key and the text, whatever else the table carries."""
    return docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), F.col("text").cast("string").alias("text"))


def unused(docs: DataFrame, name: str) -> str:
    """`name`, behind as many underscores as make it none of the table's columns."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_keys(docs: DataFrame, label: str) -> tuple[DataFrame, str, str]:
    """`docs` with two columns more, and their names: a bigint key and a flag.

    The key tells documents apart and follows the order of doc_id; it is null where doc_id is. Rows of
    one doc_id with different texts are documents of their own, in the order of a digest of the text.
    Rows equal in doc_id and text are one document: they share a key, and one of them is flagged.

    Where no doc_id repeats the key is the doc_id. Otherwise arrival numbers, keys and the keyed rows
    are written once, so a task that runs again finds the same keys; copies are counted before they
    are shuffled, and the join that hands out keys is splittable by adaptive execution.
    """
    own = F.col(DOC_ID).cast("long")
    key, lead = unused(docs, "_row"), unused(docs, "_lead")
    if docs.filter(own.isNotNull()).groupBy(own.alias("id")).count().filter("count > 1").isEmpty():
        return docs.withColumn(key, own).withColumn(lead, F.lit(True)), key, lead
    at, doc, sha = (unused(docs, n) for n in ("_at", "_doc", "_sha"))
    arrived = materialize(docs.withColumn(at, F.monotonically_increasing_id()), label)
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    different = arrived.filter(own.isNotNull()).groupBy(own.alias(doc), digest.alias(sha)).agg(F.min(at).alias(lead))
    keys = different.repartitionByRange(doc, sha).sortWithinPartitions(doc, sha).withColumn(key, F.monotonically_increasing_id())
    joined = arrived.join(materialize(keys, label), (own == F.col(doc)) & (digest == F.col(sha)), "left")
    flagged = F.coalesce(F.col(at) == F.col(lead), F.lit(True)).alias(lead)
    return materialize(joined.select(*docs.columns, key, flagged), label), key, lead


def held_out() -> Column:
    """True for the fifth of the documents that nothing is learned from."""
    return F.crc32(F.col(DOC_ID).cast("string")) % 5 == 0


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows, those whose key hashes lowest, so a rerun picks the same ones."""
    return rows.orderBy(F.xxhash64(key), key).limit(bound)


def join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Union the pairs (left[i], right[i]) in `labels`, where labels[x] is the smallest known member of x's set.

    `labels` is idempotent (labels[labels] == labels) before and after.
    """
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return
        left, right = left[apart], right[apart]
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(labels, high, low)
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels[:] = further


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it can reach.

    Alternating large-star and small-star rounds, a logarithmic number in practice. Each round is
    written to the shared scratch folder, so lineage stays one round long and lost executors cost
    tasks. Minima are aggregated before they are shuffled and the joins on a node are splittable by
    adaptive execution, so a node with very many links does not become one task's work. Nodes
    without a link to another node are absent.
    """
    scratch = Scratch(links.sparkSession, label)
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges, count = scratch.write(pairs, "r0")
    seen, n = None, 0
    while count:
        n += 1
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        stars = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(stars, "a").select(
            F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")
        )
        edges, count = scratch.write(
            small.select("e.a", F.col("e.m").alias("b")).filter("a > b").distinct(), f"r{n}"
        )
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
