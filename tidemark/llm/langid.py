"""Language identification of words with a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, doc_ids, held_out, keyed_texts, text_slices

#: Feature weights per language.
FEATURES = 1 << 16

#: Training documents at most, over all languages, and the longest text, in characters, that may be one.
TRAIN_DOCS, TRAIN_CHARS = 480, 40_000

#: Words of a training piece, and pieces of a gradient step.
PIECE, BATCH = 50, 160

#: A language a document has no letters to tell.
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages in order, feature weights (features x languages), transition and start weights, known words."""

    langs: tuple[str, ...]
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_features(words: list[bytes], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) pairs of lower-case words: every 2-, 3- and 4-byte piece of <word>, prefixes and
    suffixes of 1 to 4 bytes marked as such, and the word itself if the lexicon has it."""
    owners, features = [], []
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        flat = np.frombuffer(b"".join(b"<" + words[r] + b">" for r in rows), np.uint8)
        grid = flat.reshape(len(rows), size + 2).astype(np.uint64)
        piece = grid
        for n in (2, 3, 4):
            if n > size + 2:
                break
            piece = piece[:, :-1] * np.uint64(257) + grid[:, n - 1 :]
            ids = mixed(piece + np.uint64(n << 40)) % np.uint64(FEATURES)
            owners.append(np.repeat(rows, ids.shape[1]))
            features.append(ids.ravel())
            ends = np.stack([mixed(piece[:, 0] + np.uint64(11 << 41)), mixed(piece[:, -1] + np.uint64(13 << 41))], axis=1)
            owners.append(np.repeat(rows, 2))
            features.append((ends % np.uint64(FEATURES)).ravel())
    if len(lexicon) and len(words):
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == hashes)
        owners.append(known)
        features.append(mixed(hashes[known]) % np.uint64(FEATURES))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners).astype(np.int64), np.concatenate(features).astype(np.int64)


def scored(words: list[bytes], lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Emission scores (words x languages): mean weight over a word's features, so long words don't shout."""
    owner, feature = word_features(words, lexicon)
    count = np.maximum(1, np.bincount(owner, minlength=len(words)))
    sums = np.stack([np.bincount(owner, weights[feature, k], len(words)) for k in range(weights.shape[1])], axis=1)
    return sums / np.sqrt(count)[:, None]


def split_words(text: bytes) -> list[bytes]:
    """Lower-case words that hold a letter, with other signs at their ends taken off."""
    out = []
    for w in text.decode("utf-8", "replace").lower().split():
        w = w.strip(".,;:!?\"'()[]{}*|#$%&-_=+/\\<>~`^@")
        if w.isalpha() or any(map(str.isalpha, w)):
            out.append(w.encode())
    return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, steps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each label at each word, and of each (label, next label) pair summed over all words.

    `emit` holds the chains one after another, `lengths` their sizes (none zero). All chains advance
    together, the longer ones staying on; probabilities are rescaled at each word.
    """
    order = np.argsort(-lengths, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    sizes = lengths[order]
    top = emit.max(1, keepdims=True)
    e, move = np.exp(emit - top), np.exp(steps - steps.max())
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    forward, backward = np.empty_like(e), np.empty_like(e)
    state = np.exp(start - start.max()) * e[offsets]
    state /= state.sum(1, keepdims=True)
    forward[offsets] = state
    for t in range(1, sizes[0]):
        at = offsets[: live[t]] + t
        state = (state[: live[t]] @ move) * e[at]
        state /= state.sum(1, keepdims=True)
        forward[at] = state
    pairs = np.zeros_like(steps)
    state = np.ones((0, len(start)))
    for t in range(sizes[0] - 1, -1, -1):
        n = live[t]
        at = offsets[:n] + t
        state = np.concatenate([state, np.ones((n - len(state), len(start)))])
        backward[at] = state
        if t:
            right = e[at] * state
            left = forward[at - 1]
            norm = 1 / ((left @ move) * right).sum(1)
            pairs += move * np.einsum("ni,nj->ij", left * norm[:, None], right)
            state = right @ move.T
            state /= state.sum(1, keepdims=True)
    post = forward * backward
    return post / post.sum(1, keepdims=True), pairs


def train(texts: list[list[bytes]], labels: list[int], langs: tuple[str, ...], epochs: int = 4, seed: int = 7) -> Model:
    """Fit the field by stochastic gradient ascent; every word of a document carries its language.

    Words met in several documents form the lexicon. Texts are cut into pieces, and chains are random
    pairs of pieces, so that the transitions see switches of language as mixed texts have them.
    """
    rng = np.random.default_rng(seed)
    seen: dict[bytes, int] = {}
    for words in texts:
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1
    lexicon = np.unique(np.array([xxhash.xxh64_intdigest(w) for w, n in seen.items() if n > 1], np.uint64))
    k = len(langs)
    weights, steps, start = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    energy, step_energy = np.full((FEATURES, k), 1e-6), np.full((k, k), 1e-6)
    pieces = [(words[i : i + PIECE], label) for words, label in zip(texts, labels) for i in range(0, len(words), PIECE)]
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for lo in range(0, len(order), BATCH):
            group = [pieces[i] for i in order[lo : lo + BATCH]]
            words = [w for piece, _ in group for w in piece]
            truth = np.repeat([label for _, label in group], [len(piece) for piece, _ in group])
            lengths = np.add.reduceat([len(piece) for piece, _ in group], np.arange(0, len(group), 2))
            owner, feature = word_features(words, lexicon)
            count = np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(words))))
            emit = np.stack([np.bincount(owner, weights[feature, j], len(words)) for j in range(k)], axis=1) / count[:, None]
            post, pairs = forward_backward(emit, lengths, steps, start)
            wrong = -post
            wrong[np.arange(len(words)), truth] += 1
            share = wrong / count[:, None] / len(words)
            slope = np.stack([np.bincount(feature, share[owner, j], FEATURES) for j in range(k)], axis=1)
            energy += slope**2
            weights += 0.5 * slope / np.sqrt(energy)
            met = np.zeros((k, k))
            inner = np.ones(len(words), bool)
            inner[np.cumsum(lengths) - 1] = False
            at = np.flatnonzero(inner)
            np.add.at(met, (truth[at], truth[at + 1]), 1)
            slope = (met - pairs) / len(words)
            step_energy += slope**2
            steps += 0.3 * slope / np.sqrt(step_energy)
    return Model(langs, weights.astype(np.float32), steps, start, lexicon)


def fit(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Model:
    """Train on a bounded sample of the rows with a language: `max_docs` whole texts over all languages.

    The languages are all that the training rows name. Texts of more than `max_chars` characters are
    not sampled, which bounds what the driver trains on; prediction reads every text whole.
    """
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    langs = tuple(sorted(r.lang for r in rows.filter("text is not null").select("lang").distinct().collect()))
    if not langs:
        return Model((), np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.uint64))
    short = rows.filter(F.length("text") <= max_chars)
    ids = None
    for lang in langs:
        # Only ids are ordered, so no task sends texts to the driver that are not picked.
        some = bounded_sample(short.filter(F.col("lang") == lang).select("doc_id", "lang"), "doc_id", max(1, max_docs // len(langs)))
        ids = some if ids is None else ids.union(some)
    got = sorted(short.join(F.broadcast(ids.distinct()), ["doc_id", "lang"]).collect(), key=lambda r: (r.doc_id, r.text))
    texts = [split_words(r.text.encode()) for r in got]
    use = [i for i, t in enumerate(texts) if t]
    return train([texts[i] for i in use], [langs.index(got[i].lang) for i in use], langs)


def label_documents(texts: list[bytes], model: Model) -> list[tuple[str, float, int]]:
    """(language, its expected share of the words, words labelled) of each text."""
    words = [split_words(t) for t in texts]
    full = [i for i, w in enumerate(words) if w]
    out = [(UNKNOWN, 0.0, 0)] * len(texts)
    if not full or not model.langs:
        return out
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for i in full for w in words[i]])
    lengths = np.array([len(words[i]) for i in full])
    emit = scored(list(index), model.lexicon, model.weights)[ids]
    post, _ = forward_backward(emit, lengths, model.steps, model.start)
    share = np.add.reduceat(post, np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0) / lengths[:, None]
    best = share.argmax(1)
    for row, i in enumerate(full):
        out[i] = (model.langs[best[row]], float(min(1.0, share[row, best[row]])), int(lengths[row]))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_words) for every row: the language with the largest expected share of words.

    Null, empty and letterless texts are `und` with score 0, and so is every text if nothing could be
    learned. Repeated rows give repeated rows, ties go to the language first in order, and extra
    columns are ignored. The model is bounded by its features, so it travels with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 2 << 20):
            got = label_documents(texts, model)
            yield pa.RecordBatch.from_arrays(
                [doc_ids(batch), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())],
                ["doc_id", "lang_pred", "score", "n_words"],
            )

    return keyed_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.3) -> DataFrame:
    """`docs` without the documents that are `und`, or in which no language holds `min_score` of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 2 << 20):
            got = label_documents(texts, model)
            yield batch.filter(pa.array([g[0] != UNKNOWN and g[1] >= min_score for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
