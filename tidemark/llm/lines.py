"""Repeated runs of lines, found by winnowing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import unused, with_row_keys
from tidemark.session import Scratch

#: Lines hashed together, and hashes in a window: every repeat of GRAM + WINDOW - 1 lines is found.
GRAM, WINDOW = 1, 2


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, at, h): the hashes of the lines that hold more than blanks, and their line numbers."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    marked = F.transform("lines", lambda line, i: F.struct(i.alias("at"), F.trim(line).alias("line")))
    return (
        docs.filter("doc_id is not null and text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines"))
        .select("doc_id", F.filter(marked, lambda m: m["line"] != "").alias("m"))
        .select(
            "doc_id",
            F.transform("m", lambda m: m["at"]).alias("at"),
            F.transform("m", lambda m: F.xxhash64(m["line"])).alias("h"),
        )
    )


def numbered(count: Column) -> Column:
    """0 .. count-1, empty for a count under one."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def fingerprints(lines: DataFrame, gram: int, window: int) -> DataFrame:
    """(doc_id, lo, span, f, context, h, at): the distinct window minima of each document.

    A window is gram + window - 1 lines; the least hash of its grams, the leftmost of equals, is its
    fingerprint. A minimum is kept once, for the `span` windows in a row, from line `lo` on, whose
    minimum it is. h and at are the hashes and numbers of the lines of those windows, which is how far
    around the fingerprint a match is guaranteed to be found, and context hashes them all.
    """
    reach = gram + window - 1
    grams = F.transform(
        numbered(F.size("h") - (gram - 1)),
        lambda i: F.struct(F.xxhash64(F.slice("h", i + 1, gram)).alias("f"), i.alias("p")),
    )
    minima = F.transform(numbered(F.size("g") - (window - 1)), lambda i: F.array_min(F.slice("g", i + 1, window)))
    heads = F.filter(numbered(F.size("m")), lambda i: (i == 0) | (F.get("m", i - 1)["p"] != F.get("m", i)["p"]))
    kept = F.transform(
        "lo",
        lambda s, i: F.struct(
            s.alias("lo"),
            (F.coalesce(F.get("lo", i + 1), F.size("m")) - s).alias("span"),
            F.get("m", s)["f"].alias("f"),
        ),
    )
    around = F.col("k.span") + (reach - 1)
    # An array read inside a lambda is named twice, so that it is computed once and not for each element.
    found = lines.filter(F.size("h") >= reach).withColumn("g", grams).withColumn("m", minima).withColumn("lo", heads)
    return (
        found.select("doc_id", "h", "at", F.explode(kept).alias("k"))
        .select("doc_id", "k.*", F.slice("h", F.col("k.lo") + 1, around).alias("h"), F.slice("at", F.col("k.lo") + 1, around).alias("at"))
        .withColumn("context", F.xxhash64("h"))
    )


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, runs): the line numbers [a, b] of each maximal run that repeats earlier lines, in order.

    The places of a fingerprint are joined with the first one that agrees with them on all lines
    around it: from there the match extends both ways, over the whole of the later place. What differs
    around one fingerprint is compared window by window, once for each different context, so a line
    in a third of all documents costs its places once and its different surroundings, never pairs.
    """
    reach = gram + window - 1
    scratch = Scratch(docs.sparkSession, "lines")
    found = fingerprints(line_table(docs), gram, window)
    place = F.struct("doc_id", "lo")
    # A fingerprint met in one place only cannot lie in a repeat; partial minima keep hot ones small.
    shared = found.select("doc_id", "lo", "f").groupBy("f").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x != y").select("f")
    near, _ = scratch.write(found.join(shared, "f", "left_semi"), "places")
    contexts, _ = scratch.write(
        near.groupBy("f", "context").agg(
            F.min(F.struct("doc_id", "lo", "span", "h", "at")).alias("first"), F.max(place).alias("last")
        ).withColumn("again", F.struct("first.doc_id", "first.lo") != F.col("last")).drop("last"),
        "contexts",
    )
    firsts = contexts.filter("again").select("f", "context", F.struct("first.doc_id", "first.lo").alias("first"))
    later = near.join(firsts, ["f", "context"]).filter(place != F.col("first")).select("doc_id", "lo", (F.col("lo") + F.size("at")).alias("hi"), "at")
    mixed = contexts.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f")
    windows = (
        contexts.join(mixed, "f", "left_semi").select("f", "first.*")
        .select("f", "doc_id", "h", "at", "lo", F.explode(numbered(F.col("span"))).alias("j"))
        .select(
            "f", "doc_id", (F.col("lo") + F.col("j")).alias("lo"),
            F.xxhash64(F.slice("h", F.col("j") + 1, reach)).alias("whole"), F.slice("at", F.col("j") + 1, reach).alias("at"),
        )
    )
    equal = windows.groupBy("f", "whole").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("f", "whole", "first")
    single = windows.join(equal, ["f", "whole"]).filter(place != F.col("first")).select("doc_id", "lo", (F.col("lo") + reach).alias("hi"), "at")
    by_doc = Window.partitionBy("doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        later.union(single)
        .select("doc_id", "lo", "hi", F.element_at("at", 1).alias("a"), F.element_at("at", -1).alias("b"))
        .withColumn("broken", F.when(F.col("lo") <= before, 0).otherwise(1))
        .withColumn("run", F.sum("broken").over(by_doc))
        .groupBy("doc_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    )
    return runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def line_dedup(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """`docs` without the lines of later repeats, with n_lines and n_removed added.

    A repeat is a run of gram + window - 1 or more consecutive lines that also starts earlier: in a
    smaller doc_id or higher up in the same document. Lines compare without spaces at their ends;
    empty lines neither make nor break a run, and those inside a removed run go with it. Runs are
    judged on the input, not on what is left. Null texts stay null, with 0 lines; rows with a null
    doc_id are left as they are. Rows equal in doc_id and text are one document and come out alike;
    different texts under one doc_id are documents of their own, in the order of their SHA-256.
    Columns other than text pass through.
    """
    rows, key, lead = with_row_keys(docs, "line_rows")
    runs = repeated_runs(rows.filter(lead).select(F.col(key).alias("doc_id"), "text"), gram, window)
    doc, cut, pieces = (unused(docs, n) for n in ("_run_doc", "_runs", "_pieces"))
    joined = rows.join(runs.select(F.col("doc_id").alias(doc), F.col("runs").alias(cut)), F.col(key) == F.col(doc), "left")
    joined = joined.withColumn(pieces, F.split(F.col("text").cast("string"), "\n", -1))
    # The stretches between runs: one slice for each, whatever the number of lines.
    since = F.concat(F.array(F.lit(0)), F.transform(cut, lambda r: r["b"] + 1))
    until = F.concat(F.transform(cut, lambda r: r["a"]), F.array(F.size(pieces)))
    kept = F.flatten(F.transform(F.arrays_zip(since.alias("s"), until.alias("e")), lambda x: F.slice(pieces, x["s"] + 1, x["e"] - x["s"])))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.aggregate(cut, F.lit(0), lambda s, r: (s + r["b"] - r["a"] + 1).cast("int"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.greatest(F.size(pieces), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def with_lengths(docs: DataFrame) -> DataFrame:
    """`docs` with n_chars, where it is a column, counted again from the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
