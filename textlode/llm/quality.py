"""Quality scores by a factorisation machine.

Features are hashed words, statistics of the text's structure and metadata.  Each
has a linear weight and a short factor; the sum over all pairs of features of the
product of their factors is computed in linear time as half of the squared sum
less the sum of squares.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, append_columns, column_of, fresh, slices, texts_of, unit

BUCKETS = 1 << 15
FACTORS = 8
#: At most about so many labelled documents are learned from.
SAMPLE_DOCUMENTS = 6_000
#: Steps of learning, of so many documents each; documents come again in a new order.
STEPS = 800
BATCH = 64
THRESHOLD = 0.3

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SENTENCE = b".,;:?'\"-()"
SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
N_STRUCTURE = 18


def structure(text: str, n_chars: int | None) -> list[float]:
    """Statistics of layout, repetition and character classes of a whole text."""
    data = text.encode("utf-8")
    size = max(len(data), 1)
    words = text.split()
    n = max(len(words), 1)
    lines = [line for line in text.split("\n") if line]
    repeated = sum(map(operator.eq, words, words[1:]))

    def share(group: bytes) -> float:
        return (len(data) - len(data.translate(None, group))) / size

    return [
        1.0,
        np.log1p(len(words)),
        np.log1p(len(lines)),
        np.log1p(n_chars if n_chars is not None else len(text)),
        np.log1p(len(words) / max(len(lines), 1)),
        len(set(words)) / n,
        np.log1p(len(set(words))),
        repeated / n,
        1 - len(set(lines)) / max(len(lines), 1),
        10 * len(zlib.compress(data, 1)) / (size + 20) / 4,
        share(UPPER),
        share(DIGITS),
        share(SENTENCE),
        np.sqrt(share(SYMBOLS)),
        np.sqrt(data.count(b"|") / size),
        np.sqrt(data.count(b"!") / size),
        len(data) / n / 10,
        (len(data) - len(text)) / size,
    ]


def word_buckets(words: Iterable[str]) -> list[bytes]:
    """Bucket of each word, as the bytes of an int32."""
    return [
        (zlib.crc32(w.lower().encode("utf-8")) & BUCKETS - 1).to_bytes(4, "little") for w in words
    ]


@dataclass(frozen=True)
class Features:
    """Sparse rows: ``row``, ``column`` and ``value`` of words; dense structure apart."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def features(texts: Sequence[str], n_chars: Sequence[int | None], memo: Memo) -> Features:
    """Word counts, damped and of length one per text, and structure of some texts."""
    words = [text.split() for text in texts]
    memo.learn(*words)
    parts = [b"".join(map(memo.look, one)) for one in words]
    lengths = np.array([len(p) // 4 for p in parts], np.int64)
    buckets = np.frombuffer(b"".join(parts), "<i4").astype(np.int64)
    keys, counts = np.unique(
        np.repeat(np.arange(len(texts)), lengths) * BUCKETS + buckets, return_counts=True
    )
    row, value = keys // BUCKETS, np.log1p(counts)
    norms = np.sqrt(np.bincount(row, value * value, len(texts)))
    dense = np.array(
        [structure(t, n) for t, n in zip(texts, n_chars, strict=True)], np.float64
    ).reshape(len(texts), N_STRUCTURE)
    return Features(row, keys % BUCKETS, value / norms[row], dense)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # (BUCKETS + N_STRUCTURE,)
    factors: np.ndarray  # (BUCKETS + N_STRUCTURE, FACTORS)
    mean: np.ndarray
    spread: np.ndarray
    constant: float | None = None

    def dense(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.mean) / self.spread, -4, 4)

    def sums(self, x: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margin, summed factors and standardised structure of each text."""
        n = len(x.dense)
        dense = self.dense(x.dense)
        w, v = self.linear, self.factors
        margin = self.bias + np.bincount(x.row, x.value * w[x.column], n) + dense @ w[BUCKETS:]
        total = np.empty((n, v.shape[1]))
        squares = (dense * dense) @ (v[BUCKETS:] ** 2).sum(axis=1)
        picked = v[x.column] * x.value[:, None]
        squares += np.bincount(x.row, (picked * picked).sum(axis=1), n)
        for f in range(v.shape[1]):
            total[:, f] = np.bincount(x.row, picked[:, f], n)
        total += dense @ v[BUCKETS:]
        margin += 0.5 * ((total * total).sum(axis=1) - squares)
        return margin, total, dense

    def scores(self, x: Features) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x.dense), self.constant)
        margin, _, _ = self.sums(x)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(
    texts: Sequence[str], n_chars: Sequence[int | None], labels: Sequence[int],
    steps: int = STEPS, seed: int = 3,
) -> Machine:
    """Learn from labelled texts by logistic loss, with Adagrad steps.

    With one label or none the score is a constant: that label, or 0.5.
    """
    y = np.array(labels, np.float64)
    rng = np.random.default_rng(seed)
    size = BUCKETS + N_STRUCTURE
    machine = Machine(
        0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)),
        np.zeros(N_STRUCTURE), np.ones(N_STRUCTURE),
    )
    if len(y) == 0 or y.min() == y.max():
        machine.constant = float(y[0]) if len(y) else 0.5
        return machine
    memo = Memo(word_buckets)
    raw = features(texts, n_chars, memo)
    machine.mean = raw.dense.mean(axis=0)
    machine.spread = np.maximum(raw.dense.std(axis=0), 1e-3)
    machine.bias = float(np.log(y.mean() / (1 - y.mean())))
    starts = np.searchsorted(raw.row, np.arange(len(y) + 1))
    seen = [np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)]
    for _ in range(-(-steps * BATCH // len(y))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            spans = [np.arange(starts[r], starts[r + 1]) for r in rows]
            lengths = [len(s) for s in spans]
            pick = np.concatenate(spans)
            x = Features(
                np.repeat(np.arange(len(rows)), lengths), raw.column[pick], raw.value[pick],
                raw.dense[rows],
            )
            margin, total, dense = machine.sums(x)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            used, inverse = np.unique(x.column, return_inverse=True)
            rows_error, value = error[x.row], x.value
            w_slope = np.bincount(inverse, rows_error * value, len(used))
            v_slope = np.empty((len(used), FACTORS))
            own = machine.factors[x.column]
            for f in range(FACTORS):
                slope = rows_error * value * (total[x.row, f] - own[:, f] * value)
                v_slope[:, f] = np.bincount(inverse, slope, len(used))
            index = np.concatenate([used, np.arange(BUCKETS, size)])
            tail = machine.factors[BUCKETS:]
            dense_slope = dense.T @ (error[:, None] * total) - tail * ((dense**2).T @ error)[:, None]
            slopes = (
                np.concatenate([w_slope, dense.T @ error]),
                np.concatenate([v_slope, dense_slope]),
            )
            for parameter, slope, total_square in zip(
                (machine.linear, machine.factors), slopes, seen, strict=True
            ):
                slope = slope + 1e-5 * parameter[index]
                total_square[index] += slope * slope
                parameter[index] -= 0.1 * slope / np.sqrt(total_square[index])
            machine.bias -= 0.1 * error.sum()
    return machine


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n_chars: str | None = "n_chars",
    label: str = "quality",
    bound: int = SAMPLE_DOCUMENTS,
) -> Machine:
    """Machine learned from about ``bound`` labelled documents, chosen by a hash of the identifier.

    Only the sampled label rows are sent to the tasks, so the texts are not shuffled;
    null labels, identifiers and texts are left out.
    """
    rated = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    rated = rated.where("_id IS NOT NULL AND _label IN (0, 1)")
    n = rated.count()
    picked = rated.where(unit(F.col("_id"), seed=5) < min(1.0, bound / max(n, 1))).limit(2 * bound)
    own = docs.select(
        F.col(doc_id).alias("_id"),
        F.col(text).alias("_text"),
        (F.col(n_chars) if n_chars else F.lit(None)).cast("long").alias("_n"),
    ).where("_text IS NOT NULL")
    rows = own.join(F.broadcast(picked), "_id").select("_id", "_text", "_n", "_label")
    found = sorted(rows.limit(4 * bound).collect(), key=lambda r: (r["_id"], r["_text"]))
    return fit(
        [r["_text"] for r in found], [r["_n"] for r in found], [r["_label"] for r in found]
    )


def score(
    docs: DataFrame, machine: Machine, text: str = "text", n_chars: str | None = "n_chars",
    name: str = "score",
) -> DataFrame:
    """``docs`` with the probability that the label is 1, from the whole text.

    Null texts count as empty; these are scored from their structure like any other.
    All columns and repeated rows stay.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = texts_of(batch, text)
        sizes = (
            column_of(batch, n_chars).to_pylist() if n_chars else [None] * len(texts)
        )
        found = [
            machine.scores(features(texts[a:b], sizes[a:b], _memo())) for a, b in slices(texts)
        ]
        return [pa.array(np.concatenate(found), pa.float64())]

    return append_columns(docs, compute, [(name, T.DoubleType())])


_MEMO = Memo(word_buckets)


def _memo() -> Memo:
    """The memory of a worker; reached by name, so that it is never sent with a task."""
    return _MEMO


def keep_good(
    docs: DataFrame, machine: Machine, text: str = "text", n_chars: str | None = "n_chars",
    least: float = THRESHOLD,
) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``least``; all columns."""
    name = fresh(docs, "quality_score")
    found = score(docs, machine, text, n_chars, name)
    return found.where(F.col(name) >= least).select(*(found[c] for c in docs.columns))
