"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import weakref
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from typing import Any, ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of text that one vectorised step works on at a time.
SLICE_CHARS = 1_000_000
#: Words that a worker remembers; the memory is emptied when it is full.
MEMO_WORDS = 300_000
#: Bytes of an Arrow batch that one step computes on; a row is never cut.
PIECE_BYTES = 8 * 1024 * 1024


def append_columns(
    df: DataFrame,
    compute: Callable[[pa.RecordBatch], Sequence[pa.Array]],
    fields: Sequence[tuple[str, T.DataType]],
) -> DataFrame:
    """``df`` with columns that ``compute`` makes from each Arrow batch.

    ``fields`` must not clash with columns of ``df``; :func:`fresh` gives such names.
    """
    schema = T.StructType(
        [*df.schema.fields, *(T.StructField(name, kind) for name, kind in fields)]
    )
    names = [field.name for field in schema.fields]

    group = compute.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve(group)
        for batch in batches:
            for piece in pieces(batch):
                made = [*piece.columns, *compute(piece)]
                yield pa.RecordBatch.from_arrays(made, names=names)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``PIECE_BYTES`` in the mean, so that results stay small."""
    if batch.num_rows:
        rows = max(1, int(batch.num_rows * PIECE_BYTES / max(batch.nbytes, PIECE_BYTES)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Worker:
    """What a Python worker keeps: the objects of one operator."""

    group: ClassVar[str] = ""
    objects: ClassVar[dict] = {}


def kept(group: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """The object that ``make`` gives, made once in a worker.

    Workers serve one operator after another; the first call of another ``group`` lets all
    objects of the one before go.
    """
    serve(group)
    if key not in _Worker.objects:
        _Worker.objects[key] = make()
    return _Worker.objects[key]


def serve(group: str) -> None:
    """From now on the worker works for this operator."""
    if _Worker.group != group:
        _Worker.objects.clear()
        for memo in Memo._all:
            if memo.group != group:
                memo.known.clear()
        gc.collect()
        give_back()
        _Worker.group = group


def give_back() -> None:
    """Free memory goes back to the system, where its C library can do so; a worker would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called that."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a batch; a null text is an empty one."""
    return [text or "" for text in column_of(batch, name).to_pylist()]


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``chars`` code points together.

    A text is never cut: one longer than ``chars`` makes a range of its own.
    """
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


class Memo:
    """Remembers what ``make`` gave for a word, up to a number of words.

    ``make`` takes a list of new words and gives a value for each.  A full memory
    is emptied, so results do not depend on its size.  A worker that serves one
    operator after another keeps the words of the last one only (``group``).
    """

    _all: ClassVar[weakref.WeakSet[Memo]] = weakref.WeakSet()

    def __init__(
        self, make: Callable[[list[str]], Iterable], limit: int = MEMO_WORDS, group: str = ""
    ):
        self.make, self.limit = make, limit
        self.group = group or getattr(make, "__module__", "")
        self.known: dict = {}
        #: Value of a learned word.
        self.look = self.known.__getitem__
        Memo._all.add(self)

    def learn(self, *words: Iterable[str]) -> None:
        """Afterwards every word of the given ones can be looked up."""
        serve(self.group)
        wanted = set().union(*words)
        new = list(wanted.difference(self.known))
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(wanted)
        if new:
            self.known.update(zip(new, self.make(new), strict=True))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; null for a null identifier."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def unit(*columns: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / F.lit(float(2**53))
