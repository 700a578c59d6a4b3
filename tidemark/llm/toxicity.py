"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import DOC_ID, bounded_sample, doc_ids, held_out, keyed_texts, text_slices

#: Weights of hashed words.
FEATURES = 1 << 18

#: Confirmed toxic and unlabelled documents learned from at most, and the longest text among them.
POSITIVES, UNLABELLED, TRAIN_CHARS = 2000, 6000, 40_000

#: One word in so many, or more, has the opening.
DENSE = (64, 160, 400)

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def text_features(text: bytes, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The different lower-case words of the whole text and their openings of 4 and 5 letters, hashed,
    and how thickly words of one opening stand in it.

    A long clean text holds a telling opening once by chance, a toxic one again and again: for each
    opening of 5 letters there is a feature for every rate of `DENSE` that its words reach.
    """
    words = Counter(WORD.findall(text.decode("utf-8", "replace").lower()))
    out: list[int] = []
    stems: dict[str, int] = {}
    for w, n in words.items():
        h = known.get(w)
        if h is None:
            h = known[w] = tuple(xxhash.xxh64_intdigest(x) % FEATURES for x in {w, "^" + w[:4], "^" + w[:5]})
        out += h
        stems[w[:5]] = stems.get(w[:5], 0) + n
    total = words.total()
    for stem, n in stems.items():
        for i, rate in enumerate(DENSE):
            if n * rate >= total:
                key = f"{i}~{stem}"
                h = known.get(key)
                if h is None:
                    h = known[key] = (xxhash.xxh64_intdigest(key) % FEATURES,)
                out += h
    return np.unique(np.array(out, np.int64))


def without_copies(features: list[np.ndarray], common: float = 0.2) -> list[np.ndarray]:
    """The texts without those that share their least rare feature, in two hash orders, with an earlier one.

    Copies of a text would make its own odd words look telling.
    """
    met = np.bincount(np.concatenate([np.zeros(0, np.int64), *features]), minlength=FEATURES)
    seen, out = set(), []
    for f in features:
        rare = f[met[f] <= max(3, common * len(features))].astype(np.uint64)
        if len(rare):
            sign = tuple(int((rare * np.uint64(m) % np.uint64(1 << 61)).min()) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
            if sign in seen:
                continue
            seen.add(sign)
        out.append(f)
    return out


def margins(features: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    sizes = np.array([len(f) for f in features])
    owner = np.repeat(np.arange(len(features)), sizes)
    flat = np.concatenate([np.zeros(0, np.int64), *features])
    return np.bincount(owner, weights[flat], len(features)) + bias


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least: int = 3, excess: float = 4.0, epochs: int = 150, seed: int = 3) -> Model:
    """Linear classifier minimising the non-negative risk with the logistic loss.

    The negative part of the risk, R_u(-) - prior * R_p(-), estimates the loss on clean text from
    unlabelled text; where a batch makes it negative the classifier has overfitted, and the step goes
    against that part alone (Kiryo et al., 2017). Only features in at least `least` positives, and
    `excess` standard deviations more than chance would put there, have weights; they follow AdaGrad.
    """
    positive, unlabelled = without_copies(positive), without_copies(unlabelled)
    if not positive or not unlabelled:
        return Model(np.zeros(FEATURES), float(np.log(max(1e-6, prior) / max(1e-6, 1 - prior))) if positive else -10.0)
    rng = np.random.default_rng(seed)
    toxic, other = np.zeros(FEATURES), np.zeros(FEATURES)
    for f in positive:
        toxic[f] += 1
    for f in unlabelled:
        other[f] += 1
    expected = len(positive) * (toxic + other + 0.5) / (len(positive) + len(unlabelled))
    telling = (toxic >= least) & (toxic - expected >= excess * np.sqrt(expected + 1))
    positive = [f[telling[f]] for f in positive]
    unlabelled = [f[telling[f]] for f in unlabelled]
    weights, energy = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    bias, bias_energy = float(np.log(prior / (1 - prior))), 1e-4
    steps = max(1, min(12, len(unlabelled) // 64))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(epochs):
        p_parts, u_parts = np.array_split(rng.permutation(len(positive)), steps), np.array_split(rng.permutation(len(unlabelled)), steps)
        for p_ids, u_ids in zip(p_parts, u_parts):
            if not len(p_ids):
                p_ids = rng.integers(0, len(positive), 8)
            p, u = [positive[i] for i in p_ids], [unlabelled[i] for i in u_ids]
            zp, zu = margins(p, weights, bias), margins(u, weights, bias)
            clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp, gu = -prior * sigmoid(-zp) / len(p), np.zeros(len(u))
            if clean >= 0:
                gp = gp - prior * sigmoid(zp) / len(p)
                gu = sigmoid(zu) / len(u)
            else:
                gp = prior * sigmoid(zp) / len(p)
                gu = -sigmoid(zu) / len(u)
            flat = np.concatenate([np.zeros(0, np.int64), *p, *u])
            share = np.repeat(np.concatenate([gp, gu]), [len(f) for f in p + u])
            used, place = np.unique(flat, return_inverse=True)
            slope = np.bincount(place, share, len(used)) + 1e-5 * weights[used]
            energy[used] += slope**2
            weights[used] -= 0.5 * slope / np.sqrt(energy[used])
            slope = gp.sum() + gu.sum()
            bias_energy += slope**2
            bias -= 0.1 * slope / np.sqrt(bias_energy)
    return Model(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, max_chars: int = TRAIN_CHARS) -> Model:
    """Learn from a bounded sample of whole texts outside the held-out fifth.

    Positives are documents that `labels` confirms as toxic; every other document is unlabelled,
    whatever its label. The class prior is the toxic share among the labelled rows outside that fifth.
    The sample is learned from in the order of its ids and texts, so the model does not depend on
    how the tables are partitioned.
    """
    told = labels.filter(F.col("toxic").isNotNull() & F.col(DOC_ID).isNotNull() & ~held_out())
    told = told.groupBy(F.col(DOC_ID).cast("long").alias(DOC_ID)).agg(F.max("toxic").alias("toxic"))
    counts = told.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not counts.n or not counts.toxic:
        return Model(np.zeros(FEATURES), -10.0)
    prior = min(0.95, counts.toxic / counts.n)
    rows = keyed_texts(docs).filter(F.col(DOC_ID).isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.length("text") <= max_chars))
    yes = bounded_sample(told.filter("toxic = 1").select(DOC_ID), DOC_ID, positives)
    confirmed = sorted(rows.join(F.broadcast(yes), DOC_ID).collect())
    ids = {r.doc_id for r in confirmed}
    others = bounded_sample(rows.select(DOC_ID, F.lit(True).alias("_other")), DOC_ID, unlabelled)
    rest = [r for r in sorted(rows.join(F.broadcast(others.distinct()), DOC_ID).collect()) if r.doc_id not in ids]
    known: dict[str, tuple[int, ...]] = {}
    return train([text_features(r.text.encode(), known) for r in confirmed], [text_features(r.text.encode(), known) for r in rest], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    A null or empty text holds no word and is scored by the bias alone; without a confirmed toxic
    document to learn from every text scores near 0. Repeated rows give repeated rows, a null doc_id
    is in the held-out part's complement, and extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch, texts in text_slices(batches):
            if len(known) > 150_000:
                known.clear()
            z = margins([text_features(t, known) for t in texts], model.weights, model.bias)
            yield pa.RecordBatch.from_arrays([doc_ids(batch), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    scored = keyed_texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        DOC_ID, F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
