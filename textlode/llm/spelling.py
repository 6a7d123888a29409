"""Spelling variants by k-d trees over letter counts.

A word is a vector of how often it holds each letter.  One inserted or deleted letter moves
it by 1 in the L1 distance, one replaced letter by 2 at most, so the words one edit away lie
in a small box around it.  For each pair of lengths (equal, or one apart) a k-d tree over the
words of one length is searched from the words of the other, subtrees whose box is too far
are pruned, and what is left is verified letter by letter.

The upper levels of a length's tree deal its words to cells; a task builds the lower levels
of its cells and searches them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.plans.sizing import is_small, join_lookup
from textlode.plans.storage import stored

from .common import column_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A word counts from so many letters and occurrences on.
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A near word is the form of a word that it outnumbers so many times.
OUTNUMBERS = 5
#: One run in so many, chosen by its checksum, loses a letter.
EDIT_EVERY = 199
#: Letters a to z count for themselves, others by their code in the dimensions behind.
DIMENSIONS = 32
#: Words that a cell should hold, and most words that a task holds of one.
CELL_WORDS = 8_192
BLOCK_WORDS = 32_768
#: Words of one length that its upper levels are fitted on; all words are dealt by them.
SAMPLE_WORDS = 20_000
LEAF_WORDS = 32
#: Code points of a text that are counted at a time, and words that a task counts together.
PIECE_CHARS = 1_000_000
HELD_WORDS = 300_000
QUERY_ROWS = 4_096
PAIR_CELLS = 4_000_000


# -- words -----------------------------------------------------------------
def runs_of(text: str) -> Iterator[list[str]]:
    """Maximal runs of letters of a text, only A-Z in lower case, some at a time."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    at = 0
    while at < len(text):
        end = min(at + PIECE_CHARS, len(text))
        if end < len(text) and RUN.match(text, end - 1):
            end = RUN.match(text, end - 1).end()
        yield RUN.findall(text, at, end)
        at = end


def edited(doc_id: object, run: str, prefix: int | None = None) -> str:
    """The run, or without one letter where the checksum of document and run says so."""
    if prefix is None:
        prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    h = zlib.crc32(run.encode(), prefix)
    if h % EDIT_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of enough letters and occurrences over all documents.

    A null text has no words, a null identifier counts as an empty one.
    """
    rows = docs.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            made = [pa.array(list(total)), pa.array(list(total.values()), pa.int64())]
            total.clear()
            return pa.RecordBatch.from_arrays(made, names=["word", "n"])

        for batch in batches:
            names = column_of(batch, "doc_id").to_pylist()
            for name, body in zip(names, column_of(batch, "text"), strict=True):
                prefix = zlib.crc32(f"{name or ''}:".encode())
                for runs in runs_of(body.as_py()):
                    for word, n in Counter(runs).items():
                        if len(word) >= LEAST_LETTERS:
                            h = zlib.crc32(word.encode(), prefix)
                            if not h % EDIT_EVERY:
                                word = edited(name, word, prefix)
                                if len(word) < LEAST_LETTERS:
                                    continue
                            total[word] += n
                    if len(total) >= HELD_WORDS:
                        yield flush()
        if total:
            yield flush()

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# -- vectors and trees -----------------------------------------------------
def letters_of(words: Sequence[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row for each word."""
    data = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, "<u4").reshape(len(words), length)


def vectors_of(letters: np.ndarray) -> np.ndarray:
    """How often each word holds each letter."""
    plain = (letters >= 97) & (letters <= 122)
    dims = np.where(plain, letters - 97, 26 + letters % (DIMENSIONS - 26)).astype(np.int64)
    n = len(letters)
    flat = dims + DIMENSIONS * np.arange(n)[:, None]
    counts = np.bincount(flat.ravel(), minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    return counts.astype(np.int32)


@dataclass
class Node:
    """A box of the tree; a leaf has rows (of a task's tree) or a number (of the upper levels)."""

    low: np.ndarray
    high: np.ndarray
    below: list[Node] = field(default_factory=list)
    rows: np.ndarray | None = None
    number: int = -1


def best_split(vectors: np.ndarray) -> tuple[int, int] | None:
    """(dimension, t) that parts the rows into <= t and > t most evenly; None if all are equal."""
    n, best, found = len(vectors), 0, None
    for t in range(int(vectors.max(initial=0))):
        under = (vectors <= t).sum(axis=0)
        even = np.minimum(under, n - under)
        at = int(even.argmax())
        if even[at] > best:
            best, found = int(even[at]), (at, t)
    return found


def task_tree(vectors: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """K-d tree over some rows; each node's box just holds its rows."""
    rows = np.arange(len(vectors)) if rows is None else rows
    own = vectors[rows]
    node = Node(own.min(axis=0), own.max(axis=0))
    split = best_split(own) if len(rows) > LEAF_WORDS else None
    if split is None:
        node.rows = rows
        return node
    under = own[:, split[0]] <= split[1]
    node.below = [task_tree(vectors, rows[under]), task_tree(vectors, rows[~under])]
    return node


def upper_tree(sample: np.ndarray, leaf_rows: float) -> Node:
    """Upper levels fitted on a sample; the boxes of its leaves part the whole space."""
    number = 0

    def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Node:
        nonlocal number
        node = Node(low, high)
        split = best_split(rows) if len(rows) > max(leaf_rows, 1) else None
        if split is None:
            node.number, number = number, number + 1
            return node
        at, t = split
        under = rows[:, at] <= t
        left, right = high.copy(), low.copy()
        left[at], right[at] = t, t + 1
        node.below = [grow(rows[under], low, left), grow(rows[~under], right, high)]
        return node

    whole = np.full(DIMENSIONS, np.iinfo(np.int32).max, np.int32)
    return grow(sample, np.zeros(DIMENSIONS, np.int32), whole)


def reached(root: Node, queries: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves within ``radius`` of some queries, with the numbers of these."""
    todo = [(root, np.arange(len(queries)))]
    while todo:
        node, at = todo.pop()
        q = queries[at]
        apart = np.maximum(node.low - q, 0) + np.maximum(q - node.high, 0)
        at = at[apart.sum(axis=1) <= radius]
        if not len(at):
            continue
        if node.below:
            todo += [(child, at) for child in node.below]
        else:
            yield node, at


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which pairs of rows of code points are one edit apart; ``long`` has as many columns or one more."""
    length = short.shape[1]
    if long.shape[1] == length:
        return (short != long).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(short == long[:, :length], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= length


class Cell:
    """Words of one length in one task, to search."""

    def __init__(self, words: Sequence[str], length: int):
        self.letters = letters_of(words, length)
        self.vectors = vectors_of(self.letters)
        self.tree = task_tree(self.vectors)

    def near(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of words one edit apart; queries have the cell's length or one less."""
        queries = vectors_of(letters)
        radius = 2 if letters.shape[1] == self.letters.shape[1] else 1
        found = [(np.zeros(0, np.int64),) * 2]
        for leaf, at in reached(self.tree, queries, radius):
            step = max(1, PAIR_CELLS // (len(leaf.rows) * DIMENSIONS))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                apart = np.abs(queries[some][:, None, :] - self.vectors[leaf.rows][None])
                q, p = np.nonzero(apart.sum(axis=2) <= radius)
                q, p = some[q], leaf.rows[p]
                wide = max(1, PAIR_CELLS // letters.shape[1])
                for j in range(0, len(q), wide):
                    a, b = q[j : j + wide], p[j : j + wide]
                    ok = one_edit(letters[a], self.letters[b])
                    found.append((a[ok], b[ok]))
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))


# -- cells -----------------------------------------------------------------
def upper_trees(words: DataFrame) -> dict[int, Node]:
    """Upper levels for each length of more words than a cell should hold.

    The driver gets the numbers of those lengths and a sample of at most about
    ``SAMPLE_WORDS`` words of each, chosen by hash.
    """
    length = F.char_length("word")
    sizes = words.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n"))
    large = {r["length"]: r["n"] for r in sizes.where(F.col("n") > CELL_WORDS).collect()}
    trees = {}
    for size, n in large.items():
        rate = min(1.0, SAMPLE_WORDS / n)
        chosen = F.pmod(F.xxhash64("word", F.lit(7)), F.lit(1_000_000)) < int(rate * 1_000_000)
        sample = [r["word"] for r in words.where((length == size) & chosen).select("word").collect()]
        if sample:
            vectors = vectors_of(letters_of(sample, size))
            trees[size] = upper_tree(vectors, CELL_WORDS * len(sample) / n)
    return trees


def routed(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """(length, leaf, kind, word, n): each word to its cell and as a query to those it may reach.

    ``kind`` 0 is a word of the cell, 1 a query of the same length, 2 one a letter shorter.
    """
    names = ["length", "leaf", "kind", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = column_of(batch, "word")
            lengths = np.array([len(w) for w in held.to_pylist()])
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                own = batch.take(pa.array(rows))
                vectors = vectors_of(letters_of(column_of(own, "word").to_pylist(), length))
                for kind, size, radius in ((0, length, 0), (1, length, 2), (2, length + 1, 1)):
                    tree = trees.get(size)
                    every = np.arange(len(rows))
                    leaves = reached(tree, vectors, radius) if tree else ((None, every),)
                    for leaf, at in leaves:
                        part = own.take(pa.array(at))
                        fixed = (size, leaf.number if leaf else 0, kind)
                        made = [pa.array(np.full(len(at), v, np.int32)) for v in fixed]
                        yield pa.RecordBatch.from_arrays([*made, *part.columns], names=names)

    return words.select("word", "n").mapInArrow(
        run, "length int, leaf int, kind int, word string, n long"
    )


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``: the words of a large cell are parted, its queries go to each part."""
    cell = ["length", "leaf"]
    sizes = rows.where("kind = 0").groupBy(*cell).agg(F.count(F.lit(1)).alias("size"))
    large = stored(
        sizes.where(F.col("size") > BLOCK_WORDS).select(
            *cell, F.ceil(F.col("size") / BLOCK_WORDS).cast("int").alias("blocks")
        ),
        "blocks",
    )
    lookup = F.broadcast(large) if is_small(large) else large
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.array(F.pmod(F.xxhash64("word"), blocks).cast("int"))
    every = F.sequence(F.lit(0), blocks - 1)
    dealt = rows.join(lookup, cell, "left")
    return dealt.select(
        *cell, F.explode(F.when(F.col("kind") == 0, own).otherwise(every)).alias("block"),
        "kind", "word", "n",
    )


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, list[str], np.ndarray]]:
    """(cell, kind, words, n) of sorted rows, in pieces of one cell and kind each."""
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        words, n = column_of(batch, "word").to_pylist(), column_of(batch, "n").to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            for i in range(a, b, QUERY_ROWS):
                j = min(b, i + QUERY_ROWS)
                key = tuple(keys[i].tolist())
                yield key[:3], key[3], words[i:j], n[i:j]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one edit apart, with the other's n."""
    trees = upper_trees(words)
    rows = in_blocks(stored(routed(words, trees), "routed"))
    width = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows_of_cells(trees))
    cell = ["length", "leaf", "block"]
    dealt = rows.repartition(width, *cell).sortWithinPartitions(*cell, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, held, counts = None, None, [], []
        for at, kind, words, n in _grouped(batches):
            if at != key:
                key, cell, held, counts = at, None, [], []
            if kind == 0:
                held += words
                counts.append(n)
                continue
            if not held:
                continue
            if cell is None:
                cell, points, sizes = Cell(held, key[0]), np.array(held, object), np.concatenate(counts)
            q, p = cell.near(letters_of(words, key[0] - (kind == 2)))
            asked = np.array(words, object)
            found = [(asked[q], points[p], sizes[p])]
            if kind == 2:
                found.append((points[p], asked[q], n[q]))
            for word, near, near_n in found:
                if len(word):
                    made = [pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(near_n)]
                    yield pa.RecordBatch.from_arrays(made, names=["word", "near", "near_n"])

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def rows_of_cells(trees: dict[int, Node]) -> int:
    """Leaves of all upper levels."""

    def leaves(node: Node) -> int:
        return sum(map(leaves, node.below)) if node.below else 1

    return sum(map(leaves, trees.values()))


# -- forms -----------------------------------------------------------------
def roots(forms: DataFrame, store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """(word, root) for (word, form): the last word that following forms from a word leads to.

    Each round doubles the way that a row has gone, so rounds grow with the logarithm of the
    longest way.  Forms must not go in a circle.
    """
    ways = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = join_lookup(ways, onward, ["root"], "left")
        ways = store(
            joined.select("word", F.coalesce("next", "root").alias("root"),
                          F.col("next").isNotNull().alias("moved")), "roots"
        )
        moved = ways.where("moved").head(1)
        ways = ways.select("word", "root")
        if not moved:
            return ways


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each word once.

    The form of a word is the most frequent word one edit away (of equals the first in
    code-point order) if it occurs ``OUTNUMBERS`` times as often, else null.  No words give no
    rows.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"),
    )
    form = F.when(-F.col("best.n") >= OUTNUMBERS * F.col("n"), F.col("best.w"))
    found = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            form.alias("form"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    ways = roots(found.where("form IS NOT NULL"))
    return join_lookup(found, ways, ["word"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def document_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`variants` of the words of documents."""
    return variants(word_counts(docs, doc_id, text))
