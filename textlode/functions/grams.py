"""Counting the n-grams of documents' words with numpy, in tasks that hold a few documents at a time.

The row form of the n-gram step (``gram_rows``) makes a string of every n-gram of every word
and hashes each with its document.  Here a task cuts the n-grams of a different word once for
a chunk of documents, numbers them, and counts numbers.  Words of equal n-grams are told apart
by their code points, not by a hash, so the rows are those of ``gram_rows`` and a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a task counts at once, if they are of several documents.
CHUNK_WORDS = 300_000
#: Rows of one batch that goes back to Spark.
BATCH_ROWS = 100_000
CODE_LIMIT = 2**62
SEPARATOR = "\n"
#: Stands for a null word, of an own tokenizer, while its rows are numbers: no character.
NO_WORD = "\uffff"


def counted_grams(
    docs: DataFrame, sizes: Sequence[int], key: str = "doc_id", words: str = "words"
) -> DataFrame:
    """(key, token, tf) of documents (key, words ARRAY<STRING>); words hold no line end.

    The rows of equal keys have to lie together: in one task and one after the other.  The
    words of a document go to the task's numpy as one string, which Spark sends several
    times faster than as many.
    """
    given = docs.select(
        key, F.size(words).alias("n"), F.array_join(words, SEPARATOR).alias("joined")
    )
    out = T.StructType([given.schema[key]]).add("token", T.StringType()).add("tf", T.LongType())
    times = tuple(Counter(sizes).items())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_documents(batches, key):
            yield from _counted(table, key, times)

    return given.mapInArrow(count, out)


def counted_terms(
    rows: DataFrame, sizes: Sequence[int], *more: str, latest: bool = True
) -> DataFrame:
    """(doc_id, token, tf, ord[, more]) of (doc_id, ord, terms ARRAY<STRUCT<token, tf>>[, more]).

    The tokens of ``terms`` are words: a token has the sum of its words by document and
    ``ord``, and with ``latest`` a document has of these sums the one of highest ``ord``.
    ``more`` are columns that all rows of a document and ``ord`` have in common.  The rows of
    a document have to lie together, by ascending ``ord``.
    """
    given = _terms(rows, "ord", *more, tf=True)
    fields = {field.name: field for field in given.schema.fields}
    out = T.StructType([fields["doc_id"]]).add("token", T.StringType()).add("tf", T.LongType())
    for name in ("ord", *more):
        out = out.add(fields[name])
    times = tuple(Counter(sizes).items())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_documents(batches, "doc_id"):
            yield from _terms_counted(table, times, ("ord", *more), latest)

    return given.mapInArrow(count, out)


def counted_documents(rows: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(token, n): documents that have a token, of rows as for :func:`counted_terms`.

    A token has a row for each chunk of documents; their sum is its number of documents.
    """
    given = _terms(rows)
    times = tuple(Counter(sizes).items())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_documents(batches, "doc_id"):
            word, words = _numbered(_words(table))
            document = np.repeat(np.cumsum(_starts(table, "doc_id")) - 1, table["n"].to_numpy())
            first, token, _, tokens = word_grams(words, times)
            held = (first[1:] - first[:-1])[word]
            pair = np.sort(np.repeat(document, held) * len(tokens) + token[_runs(first[word], held)])
            once = np.append(True, pair[1:] != pair[:-1]) if len(pair) else np.zeros(0, bool)
            n = np.bincount(pair[once] % max(len(tokens), 1), minlength=len(tokens))
            yield from _batches(["token", "n"], _shown(tokens), pa.array(n.astype(np.int64)))

    return given.mapInArrow(count, "token string, n long")


def word_tokens(words: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(token, word, times): how often each of the different words of one column has a token."""
    (word,) = words.columns
    times = tuple(Counter(sizes).items())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).fill_null(NO_WORD)
            first, token, often, tokens = word_grams(held, times)
            of = pa.array(np.repeat(np.arange(len(held)), first[1:] - first[:-1]))
            yield from _batches(
                ["token", "word", "times"],
                _shown(tokens).take(pa.array(token)), batch.column(0).take(of), pa.array(often),
            )

    return words.select(word).mapInArrow(make, "token string, word string, times long")


def _terms(rows: DataFrame, *more: str, tf: bool = False) -> DataFrame:
    """(doc_id, more, n, joined, raw[, tfs]): words as one string, or as they are where one is
    null or holds the separator."""
    words = F.col("terms.token")
    joined = F.array_join(words, SEPARATOR)
    plain = (F.size(F.array_compact(words)) == F.size(words)) & ~F.contains(
        F.array_join(words, ""), F.lit(SEPARATOR)
    )
    return rows.select(
        "doc_id", *more, F.size("terms").alias("n"),
        F.when(plain, joined).alias("joined"), F.when(~plain, words).alias("raw"),
        *([F.col("terms.tf").alias("tfs")] if tf else []),
    )


def _words(table: pa.Table) -> pa.Array:
    """The words of all rows, one after the other."""
    joined, raw = table["joined"].combine_chunks(), table["raw"].combine_chunks()
    if not joined.null_count:
        return pc.split_pattern(joined, SEPARATOR).flatten()
    split = pc.split_pattern(joined, SEPARATOR).cast(pa.list_(pa.string()))
    return pc.if_else(joined.is_valid(), split, raw.cast(split.type)).flatten().fill_null(NO_WORD)


def _shown(tokens: pa.Array) -> pa.Array:
    return pc.if_else(pc.equal(tokens, NO_WORD), pa.scalar(None, pa.string()), tokens)


def _batches(names: Sequence[str], *columns: pa.Array) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([c.slice(i, BATCH_ROWS) for c in columns], list(names))


def _terms_counted(
    table: pa.Table, times: Sequence[tuple[int, int]], more: Sequence[str], latest: bool
) -> Iterator[pa.RecordBatch]:
    begins = _starts(table, "doc_id")
    run_begins = begins | _starts(table, "ord")
    at_run = np.flatnonzero(run_begins)
    document = (np.cumsum(begins) - 1)[at_run]
    word, words = _numbered(_words(table))
    run = np.repeat(np.cumsum(run_begins) - 1, table["n"].to_numpy())
    n = table["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    first, token, often, tokens = word_grams(words, times)
    held = (first[1:] - first[:-1])[word]
    at = _runs(first[word], held)
    found, tf = _summed(np.repeat(run, held) * len(tokens) + token[at], np.repeat(n, held) * often[at])
    run, token = np.divmod(found, max(len(tokens), 1))
    if latest and len(at_run) > document[-1] + 1:
        # A later row of a document overwrites its tokens.
        pair = document[run] * len(tokens) + token
        order = np.lexsort((run, pair))
        pair = pair[order]
        last = np.sort(order[np.append(pair[1:] != pair[:-1], True)])
        run, token, tf = run[last], token[last], tf[last]
    names = ["doc_id", *more]
    rows = table.select(names).take(pa.array(at_run))
    shown = _shown(tokens)
    for i in range(0, len(run), BATCH_ROWS):
        of = rows.take(pa.array(run[i : i + BATCH_ROWS])).combine_chunks()
        key, *others = (of[name].combine_chunks() for name in names)
        tokens_of = shown.take(pa.array(token[i : i + BATCH_ROWS]))
        columns = [key, tokens_of, pa.array(tf[i : i + BATCH_ROWS]), *others]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "token", "tf", *more])


def whole_documents(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Chunks of about ``CHUNK_WORDS`` words; no document is in two."""
    held: list[pa.RecordBatch] = []
    size, wanted = 0, CHUNK_WORDS
    for batch in batches:
        # Texts without words are left out here: a filter in Spark would make the words twice.
        for piece in _pieces(batch.filter(pc.greater(batch["n"], 0))):
            held.append(piece)
            size += pc.sum(piece["n"]).as_py() or 0
            if size < wanted:
                continue
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_starts(table, key))[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
            size = pc.sum(table["n"].slice(last)).as_py() or 0
            # The rows of a long document are looked through again when they have doubled.
            wanted = max(CHUNK_WORDS, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``CHUNK_WORDS`` words, a row at least."""
    part = np.cumsum(batch["n"].to_numpy().astype(np.int64)) // CHUNK_WORDS
    ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1), batch.num_rows]
    start = 0
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def _starts(table: pa.Table, key: str) -> np.ndarray:
    """Whether a row begins another document than the row before."""
    codes, _ = _numbered(table[key])
    return np.append(True, codes[1:] != codes[:-1])


def _numbered(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values, and the different values; null is one."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = pc.dictionary_encode(whole, null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _counted(
    table: pa.Table, key: str, times: Sequence[tuple[int, int]]
) -> Iterator[pa.RecordBatch]:
    starts = _starts(table, key)
    documents = table[key].filter(pa.array(starts))
    lists = pc.split_pattern(table["joined"].combine_chunks(), SEPARATOR)
    word, words = _numbered(lists.flatten())
    document = np.repeat(np.cumsum(starts) - 1, table["n"].to_numpy())
    pair, n = _summed(document * len(words) + word, np.ones(len(word), np.int64))
    document, word = np.divmod(pair, len(words))
    first, token, often, tokens = word_grams(words, times)
    held = (first[1:] - first[:-1])[word]
    at = _runs(first[word], held)
    found, tf = _summed(
        np.repeat(document, held) * len(tokens) + token[at], np.repeat(n, held) * often[at]
    )
    for i in range(0, len(found), BATCH_ROWS):
        document, token = np.divmod(found[i : i + BATCH_ROWS], len(tokens))
        keys = documents.take(pa.array(document)).combine_chunks()
        columns = [keys, tokens.take(pa.array(token)), pa.array(tf[i : i + BATCH_ROWS])]
        yield pa.RecordBatch.from_arrays(columns, [key, "token", "tf"])


def word_grams(
    words: pa.Array, times: Sequence[tuple[int, int]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Tokens of different words: for word i the numbers and counts from ``first[i]`` on.

    ``times`` has the sizes of the n-grams with how often each is made.  A word is a token of
    its own; it equals n-grams of its length only, so tokens are compared size by size.
    """
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = pa.concat_arrays([words]).buffers()
    ends = np.frombuffer(offsets, np.int32, len(words) + 1)
    content = data.to_pybytes()[ends[0] : ends[-1]] if data else b""
    point = np.frombuffer(content.decode().encode("utf-32-le"), np.uint32)
    octets = np.frombuffer(content, np.uint8)
    octet = np.append(np.flatnonzero((octets & 0xC0) != 0x80), len(octets))
    begin = np.cumsum(length) - length
    letters, letter = np.unique(point, return_inverse=True)
    base = len(letters) + 1
    own = np.flatnonzero(~np.isin(length, [size for size, _ in times]))
    of, token, often = [own], [np.arange(len(own))], [np.ones(len(own), np.int64)]
    strings, made = [words.take(pa.array(own))], len(own)
    for size, count in times:
        cut = np.maximum(length - size, 0)
        whole = np.flatnonzero(length == size)
        at = np.concatenate([_runs(begin, cut), begin[whole]])
        if not len(at):
            continue
        _, one, number = np.unique(
            _codes(letter, at, size, base), return_index=True, return_inverse=True
        )
        of.append(np.concatenate([np.repeat(np.arange(len(length)), cut), whole]))
        often.append(np.repeat([count, 1], [len(at) - len(whole), len(whole)]))
        token.append(number + made)
        strings.append(_cut(octets, octet[at[one]], octet[at[one] + size]))
        made += len(one)
    key, often = _summed(np.concatenate(of) * made + np.concatenate(token), np.concatenate(often))
    of, token = np.divmod(key, made)
    first = np.searchsorted(of, np.arange(len(length) + 1))
    return first, token, often, pa.concat_arrays(strings)


def _codes(letter: np.ndarray, at: np.ndarray, size: int, base: int) -> np.ndarray:
    """A number for each run of ``size`` letters, the same for equal ones only."""
    code, bound = letter[at], base
    for i in range(1, size):
        if bound > CODE_LIMIT // base:
            held, code = np.unique(code, return_inverse=True)
            bound = len(held)
        code, bound = code * base + letter[at + i], bound * base
    return code


def _cut(octets: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings between some octets."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    data = octets[_runs(start, size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``size`` numbers, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their weights."""
    if not len(keys):
        return keys, weights.astype(np.int64)
    bits = int(weights.max()).bit_length()
    if int(keys.max()).bit_length() + bits < 63:
        # Key and weight in one number: sorting these is several times faster than an order.
        packed = np.sort((keys << bits) | weights)
        keys, weights = packed >> bits, packed & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weights, first)
