"""Document fingerprints as invertible Bloom lookup sketches.

A text is a set of paragraph digests.  Its sketch has cells with a count, the xor
of digests and the xor of their checks; each digest is in one cell of each third.
Two versions' sketches are subtracted; cells with a single digest are peeled until
nothing is left, which recovers the digests that differ.  If peeling gets stuck,
both sketches are made again with more cells and another salt.

How fine paragraphs are is a property of the pair that is compared: both texts are cut
as the longer one of them is, so a length on the other side of a bound changes nothing
but the fineness of both.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.plans.sizing import input_bytes

from .common import slices

HASHES = 3
#: Cells of a fingerprint; a retry has ``GROWTH`` times as many.
CELLS = 60
GROWTH = 4
#: Mean bytes of a paragraph's content-defined pieces, for texts from so many bytes.  Each
#: is a multiple of those before it, so coarser cuts are some of the finer ones.
PIECE_BYTES = ((0, 4), (512, 8), (1024, 16), (2048, 32))
#: Bytes before a cut that decide on it.
WINDOW = 4
#: Stored bytes of input for one block of consecutive documents.
BLOCK_BYTES = 16 * 1024 * 1024
SLICE_CHARS = 1_000_000


# -- paragraphs ------------------------------------------------------------
def fineness(size: int) -> int:
    """Mean bytes of the pieces of a text of so many bytes."""
    return next(mean for least, mean in reversed(PIECE_BYTES) if size >= least)


def cuts(data: bytes, mean: int) -> np.ndarray:
    """Ends of the paragraphs of a text: behind line ends, and within lines where the
    hash of the last bytes says so, so that an edit moves only the cuts around it."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    mixed = codes.copy()
    for back in range(1, WINDOW):
        mixed[back:] += codes[:-back] * np.uint32(31**back)
    mixed *= np.uint32(0x9E3779B1)
    cut = (mixed >> np.uint32(20)) % np.uint32(mean) == 0
    cut |= codes == 10
    cut[-1] = True
    return np.flatnonzero(cut) + 1


def digests(texts: Sequence[bytes], means: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of all texts, cut with these mean sizes, and how many each has.

    The k-th occurrence of a paragraph has a digest of its own, so a text is a set.
    """
    found, sizes = [], []
    digest = xxhash.xxh64_intdigest
    for data, mean in zip(texts, means, strict=True):
        if not data:
            sizes.append(0)
            continue
        ends = cuts(data, mean).tolist()
        start = 0
        for end in ends:
            found.append(digest(data[start:end]))
            start = end
        sizes.append(len(ends))
    keys, counts = np.array(found, np.uint64), np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((keys, owner))
    sorted_keys, sorted_owner = keys[order], owner[order]
    if len(keys):
        first = np.concatenate(
            ([True], (sorted_keys[1:] != sorted_keys[:-1]) | (sorted_owner[1:] != sorted_owner[:-1]))
        )
        at = np.arange(len(keys))
        nth = at - np.maximum.accumulate(np.where(first, at, 0))
        keys = np.where(nth > 0, mix(sorted_keys + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), sorted_keys)
    return keys, counts


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser of a salted number."""
    values = values + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 77) >> np.uint64(32)).astype(np.uint32)


# -- sketches --------------------------------------------------------------
@dataclass
class Sketches:
    """Sketches of several texts, side by side: arrays of shape (texts, cells)."""

    count: np.ndarray
    keys: np.ndarray
    checks: np.ndarray
    salt: int

    @property
    def cells(self) -> int:
        return self.count.shape[1]

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(
            self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks, self.salt
        )

    def some(self, rows: np.ndarray) -> Sketches:
        return Sketches(self.count[rows], self.keys[rows], self.checks[rows], self.salt)

    def dump(self) -> list[str]:
        rows = np.concatenate(
            [
                self.count.astype("<i4").view(np.uint8),
                self.keys.astype("<u8").view(np.uint8),
                self.checks.astype("<u4").view(np.uint8),
            ],
            axis=1,
        )
        return [base64.b64encode(row.tobytes()).decode() for row in rows]


def places(keys: np.ndarray, cells: int, salt: int) -> Iterator[np.ndarray]:
    """The cell of each key in each third."""
    third = cells // HASHES
    for j in range(HASHES):
        where = mix(keys, salt * HASHES + j + 1) % np.uint64(third)
        yield where.astype(np.int64) + j * third


def sketch(keys: np.ndarray, counts: np.ndarray, cells: int = CELLS, salt: int = 0) -> Sketches:
    """Sketches of texts whose digests follow one another in ``keys``."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts) * cells
    checks = check(keys)
    count = np.zeros(n * cells, np.int32)
    xor, xor_check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint32)
    for where in places(keys, cells, salt):
        at = owner + where
        count += np.bincount(at, minlength=n * cells).astype(np.int32)
        np.bitwise_xor.at(xor, at, keys)
        np.bitwise_xor.at(xor_check, at, checks)
    return Sketches(
        count.reshape(n, cells), xor.reshape(n, cells), xor_check.reshape(n, cells), salt
    )


def peel(difference: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recovered digests: (text, digest, sign) arrays; which texts' peeling succeeded.

    Sign 1 marks digests of the first version only, -1 those of the second only.  All
    texts are peeled together, round by round.
    """
    n, cells = difference.count.shape
    count = difference.count.ravel().copy()
    keys, checks = difference.keys.ravel().copy(), difference.checks.ravel().copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.flatnonzero(np.abs(count) == 1)
    # Two texts' rounds cannot outnumber their digests; a false check could loop, so bound it.
    for _ in range(cells + 8):
        at = at[np.abs(count[at]) == 1]
        at = at[checks[at] == check(keys[at])]
        if not len(at):
            break
        owner, key, sign = at // cells, keys[at], count[at]
        order = np.lexsort((key, owner))
        owner, key, sign = owner[order], key[order], sign[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        owner, key, sign = owner[new], key[new], sign[new]
        found.append((owner, key, sign))
        own_check, touched = check(key), []
        for where in places(key, cells, difference.salt):
            cell = owner * cells + where
            np.subtract.at(count, cell, sign)
            np.bitwise_xor.at(keys, cell, key)
            np.bitwise_xor.at(checks, cell, own_check)
            touched.append(cell)
        at = np.unique(np.concatenate(touched))
    done = ~((count != 0) | (keys != 0) | (checks != 0)).reshape(n, cells).any(axis=1)
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty, done
    owner, key, sign = (np.concatenate(part) for part in zip(*found, strict=True))
    return owner, key, sign, done


def _rows(keys: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    spans = [keys[a:b] for a, b in zip((ends - counts)[rows], ends[rows], strict=True)]
    return np.concatenate([*spans, np.zeros(0, np.uint64)]), counts[rows]


def likeness(
    a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray],
    first: Sketches | None = None, second: Sketches | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Share of common paragraphs of each pair of texts, and the tries that it took.

    2 common / (all of both), 1 if both are empty.  ``a`` and ``b`` are the results of
    :func:`digests`; ``first`` and ``second`` their sketches if these exist.  The number
    of differing paragraphs is what peeling recovers, with ever larger sketches for the
    pairs that are stuck.
    """
    total = a[1] + b[1]
    differing, tries = np.zeros(len(total), np.int64), np.zeros(len(total), np.int64)
    open_rows = np.arange(len(total))
    cells, salt = CELLS, 0
    while len(open_rows):
        if first is None or second is None or salt:
            first = sketch(*_rows(*a, open_rows), cells, salt)
            second = sketch(*_rows(*b, open_rows), cells, salt)
        owner, _, _, done = peel(first.minus(second))
        counted = np.bincount(owner, minlength=len(open_rows))
        differing[open_rows[done]] = counted[done]
        tries[open_rows] += 1
        open_rows = open_rows[~done]
        # More cells than twice the digests of both texts never help; then only the salt changes.
        most = int(total[open_rows].max()) if len(open_rows) else 0
        cells = min(cells * GROWTH, max(cells, HASHES * -(-2 * most // HASHES)))
        salt += 1
    return np.where(total > 0, (total - np.minimum(differing, total)) / np.maximum(total, 1), 1.0), tries


class _Texts:
    """Texts with their digests and sketches, each cut as its own length wants it."""

    def __init__(self, texts: Sequence[str]):
        self.data = [text.encode("utf-8") for text in texts]
        self.means = np.array([fineness(len(data)) for data in self.data], np.int64)
        self.keys, self.counts = digests(self.data, self.means.tolist())
        self.sketches = sketch(self.keys, self.counts)

    def span(self, start: int, stop: int) -> _Texts:
        """Some consecutive texts."""
        part = object.__new__(_Texts)
        ends = np.concatenate(([0], np.cumsum(self.counts)))
        part.data, part.means = self.data[start:stop], self.means[start:stop]
        part.keys, part.counts = self.keys[ends[start] : ends[stop]], self.counts[start:stop]
        part.sketches = self.sketches.some(np.arange(start, stop))
        return part

    def cut_as(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests with other mean sizes; only texts whose size is another are cut again."""
        rows = np.flatnonzero(means != self.means)
        if not len(rows):
            return self.keys, self.counts
        keys, counts = digests([self.data[i] for i in rows], means[rows].tolist())
        spans = np.split(self.keys, np.cumsum(self.counts)[:-1])
        for row, span in zip(rows.tolist(), np.split(keys, np.cumsum(counts)[:-1]), strict=True):
            spans[row] = span
        all_counts = self.counts.copy()
        all_counts[rows] = counts
        return np.concatenate(spans), all_counts


def alike(a: _Texts, b: _Texts) -> tuple[np.ndarray, np.ndarray]:
    """Likeness of each pair of texts, both cut as the longer one is, and the tries.

    Sketches that exist are subtracted where both texts are cut alike; the others are made anew.
    """
    means = np.maximum(a.means, b.means)
    same = a.means == b.means
    first, second = a.cut_as(means), b.cut_as(means)
    near, tries = np.ones(len(means)), np.ones(len(means), np.int64)
    for rows, fitting in ((np.flatnonzero(same), True), (np.flatnonzero(~same), False)):
        if len(rows):
            made = (a.sketches.some(rows), b.sketches.some(rows)) if fitting else ()
            near[rows], tries[rows] = likeness(_rows(*first, rows), _rows(*second, rows), *made)
    return near, tries


# -- documents and their successors ----------------------------------------
def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, block, tail) so that each document's successor is in its block.

    Blocks are ranges of identifiers between actual identifiers; the first document of
    each block is also sent, as ``tail``, to the block before (that of the first block
    to the last).  Each text is shuffled once.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    n = max(
        4 * int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-input_bytes(docs) // BLOCK_BYTES),
    )
    shares = [i / n for i in range(1, n)]
    row = source.agg(
        F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares, 10_000).alias("inner")
    ).head()
    starts = sorted({row["least"], *(row["inner"] or ())} - {None})
    bounds = np.array(starts or [0], np.int64)

    @F.pandas_udf("long")
    def block_of(ids: pd.Series) -> pd.Series:
        values = ids.fillna(bounds[0]).to_numpy(np.int64)
        block = np.maximum(np.searchsorted(bounds, values, side="right") - 1, 0)
        begins = (bounds[block] == values) & ids.notna().to_numpy()
        return pd.Series(2 * block + begins)

    code = F.col("_code")
    own = F.struct(F.shiftright(code, 1).alias("block"), F.lit(0).alias("tail"))
    before = F.struct(
        F.pmod(F.shiftright(code, 1) - 1, F.lit(len(bounds))).cast("long").alias("block"),
        F.lit(1).alias("tail"),
    )
    sent = F.when(code % 2 == 1, F.array(own, before)).otherwise(F.array(own))
    return source.withColumn("_code", block_of("doc_id")).select(
        "doc_id", "text", F.inline(sent).alias("block", "tail")
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, and how like the versions are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, tries_edited, tries_next).  A fingerprint is the sketch of a text that is cut
    as its own length wants it; the tries are the sketches that a likeness took, 1 where
    the first ones could be peeled.  The following document is that of the next larger identifier, after
    the last one the first; null texts count as empty.  Rows with one identifier follow
    each other in the order of their texts' hashes, those with a null identifier come
    first.  A single document follows itself.  Equal texts have equal fingerprints.
    """
    sent = with_next(docs, doc_id, text).withColumn("tie", F.xxhash64("text"))
    dealt = sent.repartition("block").sortWithinPartitions("block", "tail", "doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, int]] = []  # rows whose successor is not here yet
        block_done: int | None = None
        for batch in batches:
            ids, texts, blocks, tails, _ = (c.to_pylist() for c in batch.columns)
            ready: list[tuple[int | None, str, str]] = []
            for name, own, block, tail in zip(ids, texts, blocks, tails, strict=True):
                own = own or ""
                if block == block_done:
                    continue  # further rows with the identifier of the tail
                if held:
                    last, last_text, _ = held.pop()
                    ready.append((last, last_text, own))
                if tail:
                    block_done = block
                else:
                    held.append((name, own, block))
            for a, b in slices([r[1] for r in ready], SLICE_CHARS):
                yield _compare(ready[a:b])
        if held:  # only where no identifier is known
            yield _compare([(name, own, "") for name, own, _ in held])

    return dealt.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double, "
        "tries_edited int, tries_next int",
    )


def _compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    texts = [text for _, text, _ in rows]
    changed = [edited(text, following) for _, text, following in rows]
    # Mostly each row's successor is the next row; only the others are read again.
    chained = all(rows[i][2] is rows[i + 1][1] for i in range(len(rows) - 1))
    new = _Texts(changed)
    if chained:
        line = _Texts([*texts, rows[-1][2]])
        own, following = line.span(0, len(rows)), line.span(1, len(rows) + 1)
    else:
        own, following = _Texts(texts), _Texts([following for _, _, following in rows])
    near_edited, tries_edited = alike(own, new)
    near_next, tries_next = alike(own, following)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name for name, _, _ in rows], pa.int64()),
            pa.array([len(text) for text in texts], pa.int64()),
            pa.array([hashlib.sha256(data).hexdigest() for data in new.data]),
            pa.array(own.sketches.dump()),
            pa.array(new.sketches.dump()),
            pa.array(near_edited),
            pa.array(near_next),
            pa.array(tries_edited, pa.int32()),
            pa.array(tries_next, pa.int32()),
        ],
        names=[
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            "near_edited", "near_next", "tries_edited", "tries_next",
        ],
    )
