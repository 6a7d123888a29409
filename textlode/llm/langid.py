"""Language identification with a linear-chain conditional random field.

Every word of a text gets a label; the label of the text is the one with the most
expected words.  A word's score is a sum of weights of its affixes, character
n-grams and lexicon entry; labels of neighbouring words are tied by learned
transitions, and forward-backward gives each word's label probabilities, so a
text that switches languages is split where the words change.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, append_columns, fresh, kept, slices, texts_of, unit

UNKNOWN = "und"
#: Least mean probability of a document's language that is not rejected.
LEAST = 0.3
#: At most about so many labelled documents are learned from.
SAMPLE_DOCUMENTS = 600
BUCKETS = 1 << 16
#: Words of the training sample that get a weight of their own.
LEXICON_WORDS = 4_000
#: A longer run of letters is as many words as pieces of at most so many letters need.
WORD_CHARS = 24
#: Learned stretches of one language within a training sequence, in words.
STRETCH = 12
SEQUENCE = 48
STEPS = 40
#: Longer texts are worked on in windows of so many words ...
WINDOW = 2_048
#: ... that begin and end so many words outside what they decide.  A word's influence
#: shrinks by a factor below 0.95 with each word, so it is nil in single precision.
MARGIN = 320
#: Texts worked on at a time; a chunk takes some ten times its characters, as an object and in scores.
SLICE_CHARS = 2_000_000
#: Words whose features are held at a time.
BLOCK_WORDS = 1 << 16


_RUNS = re.compile(r"[^\W\d_]+")


# -- words and features ----------------------------------------------------
def pieces_of(run: str) -> list[str]:
    """A letter run in the fewest pieces of at most ``WORD_CHARS`` letters, nearly equal ones."""
    n, size = -(-len(run) // WORD_CHARS), len(run)
    return [run[i * size // n : (i + 1) * size // n] for i in range(n)]


def letters_of(chunk: str) -> list[str]:
    """Letter runs of a chunk without white space, long ones in pieces."""
    if chunk.isalpha():
        return [chunk] if len(chunk) <= WORD_CHARS else pieces_of(chunk)
    found = _RUNS.findall(chunk)
    if not all(map(str.isalpha, found)):
        found = "".join(c if c.isalpha() else " " for c in chunk).split()
    if len(chunk) <= WORD_CHARS:
        return found
    return [piece for run in found for piece in pieces_of(run)]


def shape(words: Sequence[str]) -> np.ndarray:
    """Code points of words, one row each, between a start and an end mark."""
    marked = np.array([f"\x02{w}\x03" for w in words], f"U{WORD_CHARS + 2}")
    return marked.view(np.uint32).reshape(len(words), WORD_CHARS + 2).astype(np.int64)


def features(words: Sequence[str], lexicon: dict[str, int]) -> np.ndarray:
    """Bucket numbers of each word's features; ``BUCKETS`` stands for none.

    Bigrams and trigrams everywhere, prefixes and suffixes of up to three letters
    and the word itself if the lexicon has it.
    """
    chars = shape(words)
    n = (chars != 0).sum(axis=1)
    rows = np.arange(len(words))

    def bucket(kind: int, *parts: np.ndarray) -> np.ndarray:
        mixed = np.full(parts[0].shape, kind + 1, np.int64)
        for part in parts:
            mixed = (mixed * 1_000_003 ^ part) & 0xFFFFFFFFFFFF
        mixed ^= mixed >> 17
        return (mixed * 0x9E3779B1 >> 15) & (BUCKETS - 1)

    def masked(values: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, values, BUCKETS)

    columns = [
        masked(bucket(0, chars[:, :-1], chars[:, 1:]), chars[:, 1:] != 0),
        masked(bucket(1, chars[:, :-2], chars[:, 1:-1], chars[:, 2:]), chars[:, 2:] != 0),
    ]
    for size in (1, 2, 3):
        first = [chars[:, 1 + i] for i in range(size)]
        last = [chars[rows, np.maximum(n - 2 - i, 0)] for i in range(size)]
        long_enough = n - 2 >= size
        columns.append(masked(bucket(2 + size, *first), long_enough)[:, None])
        columns.append(masked(bucket(5 + size, *last), long_enough)[:, None])
    known = np.array([lexicon.get(w, -1) for w in words], np.int64)
    columns.append(masked(bucket(9, known), known >= 0)[:, None])
    return np.concatenate(columns, axis=1)


# -- forward-backward ------------------------------------------------------
def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray):
    """Label probabilities of each word, expected transitions and log normalisers.

    ``scores`` holds the words of all sequences one after another, each sequence of
    a length above zero; ``transitions`` holds log weights.  All sequences advance
    together, longest first, so a step is one small matrix product.
    """
    labels = scores.shape[1]
    top = scores.max(axis=1, keepdims=True)
    local = np.exp(scores - top)
    step = np.exp(transitions).astype(scores.dtype)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    forward, scale = np.empty_like(local), np.empty(len(local), scores.dtype)
    state = np.full((len(sizes), labels), 1.0 / labels, scores.dtype)
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        state = (state[:n] @ step if t else state[:n]) * local[at]
        total = state.sum(axis=1)
        state /= total[:, None]
        forward[at], scale[at] = state, total
    backward = np.ones_like(local)
    pairs = np.zeros((labels, labels))
    state = np.ones((0, labels), scores.dtype)
    for t in range(len(active) - 1, 0, -1):
        n = active[t]
        at = starts[:n] + t
        if len(state) < n:
            state = np.concatenate([state, np.ones((n - len(state), labels), scores.dtype)])
        ahead = state * local[at] / scale[at][:, None]
        pairs += forward[at - 1].T @ ahead
        state = ahead @ step.T
        backward[at - 1] = state
    inner = forward * backward
    inner /= inner.sum(axis=1, keepdims=True)
    logs = np.log(scale) + top[:, 0]
    return inner, pairs * step, logs


def expected(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Mean label probabilities of each sequence; long ones go in overlapping windows."""
    begins = np.cumsum(lengths) - lengths
    parts = np.maximum(1, -(-lengths // WINDOW))
    owner = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = nth * WINDOW
    last = np.minimum(first + WINDOW, lengths[owner])
    left, right = np.maximum(first - MARGIN, 0), np.minimum(last + MARGIN, lengths[owner])
    sizes = right - left
    if len(owner) > len(lengths):
        shift = np.repeat(begins[owner] + left - (np.cumsum(sizes) - sizes), sizes)
        scores = scores[shift + np.arange(len(shift))]
    inner, _, _ = marginals(scores, sizes, transitions)
    at = np.cumsum(sizes) - sizes
    bounds = np.stack([at + first - left, at + last - left], axis=1).ravel()
    inner = np.concatenate([inner, np.zeros((1, inner.shape[1]), inner.dtype)])
    sums = np.add.reduceat(inner, bounds, axis=0, dtype=np.float64)[::2]
    total = np.stack(
        [np.bincount(owner, sums[:, i], len(lengths)) for i in range(sums.shape[1])], axis=1
    )
    return total / lengths[:, None]


# -- model -----------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    name: str
    labels: list[str]
    weights: np.ndarray  # (BUCKETS + 1, labels)
    transitions: np.ndarray  # (labels, labels), log weights
    lexicon: dict[str, int]

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        scores = np.zeros((len(words), len(self.labels)), np.float32)
        for at in range(0, len(words), BLOCK_WORDS):
            part = scores[at : at + BLOCK_WORDS]
            for column in features(words[at : at + BLOCK_WORDS], self.lexicon).T:
                part += self.weights[column]
        return scores

    def chunk_scores(self, chunks: Sequence[str]) -> list[bytes]:
        """Scores of the words of each chunk, as the bytes of their matrix."""
        words = [letters_of(chunk) for chunk in chunks]
        counts = [len(w) for w in words]
        flat = self.word_scores([w for one in words for w in one])
        ends = np.cumsum(counts, dtype=np.int64).tolist()
        return [
            flat[end - n : end].tobytes() for end, n in zip(ends, counts, strict=True)
        ]


def _spliced(texts: list[list[str]], labels: list[int], seed: int):
    """Training sequences: stretches of documents, changing the language now and then."""
    rng = np.random.default_rng(seed)
    pieces: list[tuple[int, list[str]]] = []
    for words, label in zip(texts, labels, strict=True):
        at = 0
        while at < len(words):
            n = int(rng.integers(STRETCH // 2, 2 * STRETCH))
            pieces.append((label, words[at : at + n]))
            at += n
    order = rng.permutation(len(pieces))
    words, tags, lengths = [], [], []
    size = 0
    for i in order.tolist():
        label, piece = pieces[i]
        words += piece
        tags += [label] * len(piece)
        size += len(piece)
        if size >= SEQUENCE:
            lengths.append(size)
            size = 0
    if size:
        lengths.append(size)
    return words, np.array(tags, np.int64), np.array(lengths, np.int64)


def fit(texts: Sequence[str], langs: Sequence[str], steps: int = STEPS, seed: int = 7) -> Model:
    """Learn from labelled texts by maximum likelihood (Adam, all sequences a step).

    No texts with words give a model without labels, which answers ``und``.
    """
    split = [[w for c in t.lower().split() for w in letters_of(c)] for t in texts]
    used = [(w, lang) for w, lang in zip(split, langs, strict=True) if w]
    labels = sorted({lang for _, lang in used})
    k = len(labels)
    weights = np.zeros((BUCKETS + 1, max(k, 1)), np.float32)
    transitions = np.zeros((max(k, 1), max(k, 1)))
    counts = Counter(w for words, _ in used for w in words)
    common = sorted(counts, key=lambda w: (-counts[w], w))[:LEXICON_WORDS]
    lexicon = {w: i for i, w in enumerate(common)}
    if k < 2:
        return Model(uuid.uuid4().hex, labels, weights, transitions, lexicon)
    place = {lang: i for i, lang in enumerate(labels)}
    words, tags, lengths = _spliced(
        [w for w, _ in used], [place[lang] for _, lang in used], seed
    )
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    which = np.array([distinct[w] for w in words], np.int64)
    buckets = features(list(distinct), lexicon)
    gold = np.eye(k)[tags]
    inside = np.ones(len(tags), bool)
    inside[np.cumsum(lengths) - lengths] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (tags[:-1][inside[1:]], tags[1:][inside[1:]]), 1)
    moments = [[np.zeros_like(p, np.float64) for _ in range(2)] for p in (weights, transitions)]
    for step in range(1, steps + 1):
        base = np.zeros((len(distinct), k), np.float32)
        for column in buckets.T:
            base += weights[column]
        inner, pairs, _ = marginals(base[which].astype(np.float64), lengths, transitions)
        error = inner - gold
        by_word = np.stack(
            [np.bincount(which, error[:, i], len(distinct)) for i in range(k)], axis=1
        )
        flat, repeat = buckets.ravel(), buckets.shape[1]
        gradient = np.stack(
            [np.bincount(flat, np.repeat(by_word[:, i], repeat), BUCKETS + 1) for i in range(k)],
            axis=1,
        )
        gradient = gradient / len(tags) + 1e-7 * weights
        for parameter, slope, (mean, square) in zip(
            (weights, transitions), (gradient, (pairs - seen) / len(tags)), moments, strict=True
        ):
            mean *= 0.9
            mean += 0.1 * slope
            square *= 0.99
            square += 0.01 * slope * slope
            rate = 0.1 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            parameter -= (rate * mean / (np.sqrt(square) + 1e-8)).astype(parameter.dtype)
        weights[BUCKETS] = 0
    return Model(uuid.uuid4().hex, labels, weights, transitions, lexicon)


def sample(
    docs: DataFrame, text: str, label: str, bound: int = SAMPLE_DOCUMENTS
) -> tuple[list[str], list[str]]:
    """About ``bound`` labelled texts, as many of each label, chosen by a hash of the text.

    Labels are counted over all rows; a label's rows pass with the probability that
    gives its share, so only the sample reaches the driver.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    rows = rows.where("text IS NOT NULL AND label IS NOT NULL")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return [], []
    share = bound / len(counts)
    rate = reduce(
        lambda case, item: case.when(F.col("label") == item[0], min(1.0, share / item[1])),
        counts.items(),
        F.when(F.lit(False), 0.0),
    )
    picked = rows.where(unit(F.col("text"), seed=11) < rate).limit(2 * bound).collect()
    picked.sort(key=lambda r: (r["label"], r["text"]))
    return [r["text"] for r in picked], [r["label"] for r in picked]


def train(docs: DataFrame, text: str = "text", label: str = "lang", bound: int = SAMPLE_DOCUMENTS) -> Model:
    """Model of the labelled rows of ``docs``; rows with a null text or label are left out."""
    return fit(*sample(docs, text, label, bound))


# -- prediction ------------------------------------------------------------
def label_texts(texts: Sequence[str], model: Model, memo: Memo) -> tuple[list[str], np.ndarray]:
    """Label and score of each text; see :func:`predict`."""
    k = len(model.labels)
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not k:
        return names, scores
    for start, end in slices(texts, SLICE_CHARS):
        chunks = [text.lower().split() for text in texts[start:end]]
        memo.learn(*chunks)
        parts = [b"".join(map(memo.look, one)) for one in chunks]
        lengths = np.array([len(p) // (4 * k) for p in parts], np.int64)
        if not lengths.any():
            continue
        flat = np.frombuffer(b"".join(parts), np.float32).reshape(-1, k)
        where = np.flatnonzero(lengths)
        shares = np.minimum(expected(flat, lengths[where], model.transitions), 1.0)
        best = shares.argmax(axis=1)
        for row, i, share in zip(where.tolist(), best.tolist(), shares.max(axis=1), strict=True):
            names[start + row], scores[start + row] = model.labels[i], share
    return names, scores


def predict(
    docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """``docs`` with the predicted label and its score, the mean probability of its words.

    Words are lower-cased letter runs of the whole text, or the pieces of long ones.  A null text and one without
    a letter get ``und`` and score 0, as does every text if the model knows no label;
    ties go to the label that sorts first.  All columns and repeated rows stay.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        names, scores = label_texts(texts_of(batch, text), model, _memo(model))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(docs, compute, [(pred, T.StringType()), (score, T.DoubleType())])


def _memo(model: Model) -> Memo:
    """The memory of a worker for the model of its tasks."""
    return kept(__name__, model.name, lambda: Memo(model.chunk_scores, group=__name__))


def keep_identified(
    docs: DataFrame, model: Model, text: str = "text", least: float = LEAST
) -> DataFrame:
    """Rows of ``docs`` in a known language: a label, for at least ``least`` of the words."""
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = predict(docs, model, text, pred, score)
    kept = (F.col(pred) != UNKNOWN) & (F.col(score) >= least)
    return found.where(kept).select(*(found[c] for c in docs.columns))
