"""URL filtering: host and path rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One of these rejects a url.
STRICT = ("adult", "casino", "escort", "jackpot", "malware", "phishing", "porn", "sex", "spam", "viagra", "xxx")

#: Several different ones of these reject a url.
SOFT = (
    "ads", "bet", "bets", "bonus", "buy", "cheap", "coupon", "deal", "farm", "free", "loan",
    "pills", "poker", "track", "win", "winner",
)

#: Different soft terms that reject together.
SOFT_LIMIT = 2

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    """Whether a rule like example.com/en/ covers the host or one above it, and starts the path."""
    where, slash, rest = rule.partition("/")
    return ((host == where) | host.endswith("." + where)) & path.startswith(slash + rest)


def vocabulary(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def hits(url: str, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """Different strict and different soft terms that stand in `url` with no letter or digit beside them."""
    text = "".join(c.lower() if c.isascii() else c for c in url)
    seen = set()
    for end, (term, weight) in terms.iter(text):
        start = end - len(term) + 1
        before, after = text[start - 1 : start] if start else "", text[end + 1 : end + 2]
        if not any(c.isascii() and c.isalnum() for c in (before, after) if c):
            seen.add((term, weight))
    strict = sum(weight == 2 for _, weight in seen)
    return strict, len(seen) - strict


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[Rule] = (),
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft) for every row of `pages`.

    `rules` are (verdict, pattern); of those that fit, the longest pattern decides, else the
    vocabulary: one strict term or `soft_limit` different soft ones anywhere in the whole url block
    it. A null or empty url, or one without ://, has an empty host and path, so no rule fits; a null
    one holds no term and is allowed. Repeated rows give repeated rows; extra columns are ignored.
    """
    if not strict and not soft:
        raise ValueError("the vocabulary is empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary(strict, soft)
        for batch in batches:
            counts = [hits(u or "", terms) for u in batch.column(1).to_pylist()]
            extra = [pa.array([c[k] for c in counts], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["page_id", "url", "n_strict", "n_soft"])

    counted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(
        run, "page_id long, url string, n_strict int, n_soft int"
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = F.lit(None).cast("string"), F.when(
        (F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block"
    ).otherwise("allow")
    for said, pattern in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        fit = fits(pattern, F.col("host"), F.col("path"))
        rule, verdict = F.when(fit, pattern).otherwise(rule), F.when(fit, said).otherwise(verdict)
    return counted.select("page_id", host.alias("host"), path.alias("path"), "n_strict", "n_soft").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft"
    )
