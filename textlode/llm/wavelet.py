"""Token files as wavelet matrices.

A shard holds the identifiers of consecutive documents.  The matrix has a bit
plane for each bit of an identifier, highest first; behind each plane the tokens
with a zero come before those with a one, in unchanged order.  With counts of ones
per block, a token is read, counted or found in a step for each plane.
"""

from __future__ import annotations

import json
import re
import string
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from textlode.plans.storage import new_folder

from .bpe import byte_letters
from .common import Memo, kept, pieces
from .components import stored
from .files import create, reader, task_file

MAGIC = b"WVLT0001"
END_ID = 1
#: Bits between two stored counts of ones.
BLOCK = 512
#: A shard is closed with the document that reaches so many tokens.
SHARD_TOKENS = 4_000_000
MEMO_WORDS = 500_000
#: Latin letters with one letter as lower case, composed, and letters to every version of Unicode.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: A run of them with ASCII marks behind it.
PLAIN = f"^(?P<word>[{LATIN}]+)(?P<marks>[{re.escape(string.punctuation)}]*)$"
#: Runs of other letters that are encoded at a call.
RUN = 400


@dataclass
class WaveletMatrix:
    """Sequence of unsigned numbers below ``2 ** levels``."""

    size: int
    levels: int
    planes: list[np.ndarray]  # uint8, packed, lowest bit first
    zeros: list[int]
    counts: list[np.ndarray] = field(default_factory=list)  # ones before each block

    def __post_init__(self):
        if not self.counts:
            self.counts = [self._blocks(p) for p in self.planes]

    @staticmethod
    def _blocks(plane: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.int64)
        return np.concatenate(([0], np.cumsum(ones)))

    @classmethod
    def build(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        rest = np.ascontiguousarray(values, np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in reversed(range(levels)):
            bits = (rest & rest.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bits, bitorder="little"))
            low, high = rest[~bits], rest[bits]
            zeros.append(len(low))
            rest = np.concatenate([low, high])
        return cls(len(values), levels, planes, zeros)

    def values(self) -> np.ndarray:
        """All numbers: the planes are undone from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        found = np.zeros(self.size, kind)
        for bit, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            bits = np.unpackbits(plane, count=self.size, bitorder="little").astype(bool)
            merged = np.empty_like(found)
            merged[~bits] = found[:zeros]
            merged[bits] = found[zeros:] | kind(1 << bit)
            found = merged
        return found

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        plane = self.planes[level]
        block = at // BLOCK
        found = self.counts[level][block]
        inside = at - block * BLOCK
        window = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
        part = np.where(window < len(plane), plane[np.minimum(window, max(len(plane) - 1, 0))], 0)
        bits = np.unpackbits(part.astype(np.uint8), axis=1, bitorder="little")
        return found + (bits * (np.arange(BLOCK) < inside[:, None])).sum(axis=1, dtype=np.int64)

    def access(self, at: Sequence[int]) -> np.ndarray:
        """The numbers at some positions."""
        at = np.asarray(at, np.int64)
        found = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            bit = self.planes[level][at >> 3] >> (at & 7).astype(np.uint8) & 1
            ones = self._ones(level, at)
            found = found << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return found

    def _span(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a number before ``end`` lie behind the last plane."""
        span = np.array([0, end], np.int64)
        for level in range(self.levels):
            ones = self._ones(level, span)
            if value >> (self.levels - 1 - level) & 1:
                span = self.zeros[level] + ones
            else:
                span = span - ones
        return int(span[0]), int(span[1])

    def rank(self, value: int, end: int) -> int:
        """Occurrences of a number before position ``end``."""
        if value < 0 or value >> self.levels or not self.size:
            return 0
        first, last = self._span(value, min(end, self.size))
        return last - first

    def select(self, value: int, nth: int) -> int:
        """Position of the ``nth`` occurrence of a number, from 0; -1 if it has fewer."""
        if nth < 0 or nth >= self.rank(value, self.size):
            return -1
        at = self._span(value, self.size)[0] + nth
        for level in reversed(range(self.levels)):
            one = value >> (self.levels - 1 - level) & 1
            at = self._select_bit(level, at - self.zeros[level] if one else at, one)
        return at

    def _select_bit(self, level: int, nth: int, one: int) -> int:
        ones = self.counts[level]
        before = ones if one else np.minimum(np.arange(len(ones)) * BLOCK, self.size) - ones
        block = int(np.searchsorted(before, nth, side="right")) - 1
        part = self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)]
        bits = np.unpackbits(part, bitorder="little")[: self.size - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[nth - int(before[block])])


@dataclass
class Shard:
    """Documents in order: identifiers (None where null), token counts and the matrix."""

    doc_ids: list[int | None]
    lengths: np.ndarray
    matrix: WaveletMatrix

    def dump(self) -> bytes:
        """One file: a head with the sizes of its parts, then the parts, each compressed."""
        pack = zstandard.ZstdCompressor(level=1).compress
        ids = np.array([i or 0 for i in self.doc_ids], "<i8")
        null = np.array([i is None for i in self.doc_ids], np.uint8)
        parts = [
            pack(a.tobytes())
            for a in (ids, null, self.lengths.astype("<i8"), *self.matrix.planes)
        ]
        head = json.dumps(
            {
                "documents": len(self.doc_ids),
                "tokens": self.matrix.size,
                "levels": self.matrix.levels,
                "zeros": self.matrix.zeros,
                "parts": [len(p) for p in parts],
                "crc32": [zlib.crc32(p) for p in parts],
            }
        ).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])

    @classmethod
    def load(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack("<I", data[8:12])
        head = json.loads(data[12 : 12 + size])
        unpack = zstandard.ZstdDecompressor().decompress
        at, parts = 12 + size, []
        for n, crc in zip(head["parts"], head["crc32"], strict=True):
            part = data[at : at + n]
            if zlib.crc32(part) != crc:
                raise ValueError("a part of the token file is damaged")
            parts.append(unpack(part))
            at += n
        ids, null = np.frombuffer(parts[0], "<i8").tolist(), parts[1]
        planes = [np.frombuffer(p, np.uint8) for p in parts[3:]]
        matrix = WaveletMatrix(head["tokens"], head["levels"], planes, head["zeros"])
        lengths = np.frombuffer(parts[2], "<i8")
        return cls([None if n else i for i, n in zip(ids, null, strict=True)], lengths, matrix)


class _Encoder:
    """The library's identifiers of whole texts; parts between white space are remembered.

    A part that is a run of letters, or one with ASCII marks behind it, is two pieces for
    the library at most.  Its letters are remembered for all such parts; Latin ones go to
    the library's model as they are, for normaliser and pattern change nothing in them.
    Many runs of other letters are encoded as one text, whose words end where an identifier
    ends a word.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab()
        self.levels = max(1, max(vocab.values()).bit_length())
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        # Runs of letters in lower case need no normalising, and white space parts them.
        self.runs = Tokenizer.from_file(path)
        self.runs.no_padding()
        self.runs.no_truncation()
        self.runs.normalizer = normalizers.Sequence([])
        self.runs.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        self.bytes = dict(enumerate(byte_letters()))
        self.latin = Memo(self._latin, MEMO_WORDS)
        self.letters = Memo(self._letters, MEMO_WORDS)
        self.marks = Memo(self._whole, MEMO_WORDS)
        self.others = Memo(self._others, MEMO_WORDS)

    def _whole(self, chunks: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(m.ids, "<u4").tobytes() for m in made]

    def _latin(self, words: list[str]) -> Iterator[bytes]:
        """Identifiers of runs of Latin letters in lower case."""
        tokens, table = self.runs.model.tokenize, self.bytes
        for word in words:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(table)
            yield array("I", [token.id for token in tokens(spelt)]).tobytes()

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """The same for any letters, some hundred at a call."""
        for at in range(0, len(words), RUN):
            part = words[at : at + RUN]
            (made,) = self.runs.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(made.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                yield from self._whole(part)
                continue
            data, start = ids.tobytes(), 0
            for end in (4 * ends).tolist():
                yield data[start:end]
                start = end

    def _others(self, chunks: list[str]) -> list[bytes]:
        """Identifiers of parts that are not Latin letters with ASCII marks behind them."""
        words, marks, odd = [], [], []
        for chunk in chunks:
            word = chunk.rstrip(string.punctuation)
            low = word.lower()
            known = low.isalpha() and (low.isascii() or self._settled(low))
            words.append(low if known else "")
            marks.append(chunk[len(word) :] if known else "")
            if not known:
                odd.append(chunk)
        self.letters.learn(filter(None, words))
        self.marks.learn(marks)
        look, behind, rest = self.letters.look, self.marks.look, iter(self._whole(odd))
        return [
            look(word) + behind(mark) if word else next(rest)
            for word, mark in zip(words, marks, strict=True)
        ]

    @staticmethod
    def _settled(word: str) -> bool:
        """Letters that lower case and composition leave as they are, however they are applied."""
        return (
            "σ" not in word and "ς" not in word and unicodedata.is_normalized("NFC", word)
            and word.lower() == word
        )

    def _parts(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of different parts, one after another, and how many each part has."""
        found = pc.extract_regex(chunks, PLAIN)
        plain = found.is_valid()
        words = pc.utf8_lower(pc.struct_field(found, "word").filter(plain)).dictionary_encode()
        marks = pc.struct_field(found, "marks").filter(plain).dictionary_encode()
        made: list[bytes] = []
        for memo, wanted in (
            (self.latin, words.dictionary),
            (self.marks, marks.dictionary),
            (self.others, chunks.filter(pc.invert(plain))),
        ):
            strings = wanted.to_numpy(zero_copy_only=False).tolist()
            memo.learn(strings)
            made.extend(map(memo.look, strings))
        made.append(b"")
        # A plain part is its word and its marks, any other is one piece and nothing.
        known = plain.to_numpy(zero_copy_only=False)
        units = np.full((len(chunks), 2), len(made) - 1)
        units[known, 0] = words.indices.to_numpy()
        units[known, 1] = marks.indices.to_numpy() + len(words.dictionary)
        rest = len(words.dictionary) + len(marks.dictionary)
        units[~known, 0] = np.arange(rest, len(made) - 1)
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        ids, sizes = _taken(np.frombuffer(b"".join(made), "<u4"), size, units.ravel())
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Bytes of uint32 identifiers of each text, with the end mark; null texts are empty.

        Texts part at ASCII white space, at which the library's tokens never join; the
        different parts of a batch are encoded once.
        """
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = parts.flatten().dictionary_encode()
        ids, sizes = _taken(*self._parts(coded.dictionary), coded.indices.to_numpy())
        ends = np.concatenate(([0], np.cumsum(sizes)))
        data, end = ids.tobytes(), struct.pack("<I", END_ID)
        start, out = 0, []
        for stop in (4 * ends[np.diff(parts.offsets.to_numpy()).cumsum()]).tolist():
            out.append(data[start:stop] + end)
            start = stop
        return out


def _taken(ids: np.ndarray, sizes: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``nth`` runs of those that lie one after another in ``ids``, and their sizes."""
    first, size = (np.cumsum(sizes) - sizes)[nth], sizes[nth]
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(first - ends + size, size)
    return ids[at], size


def _encoder(path: str) -> _Encoder:
    return kept(__name__, path, lambda: _Encoder(path))


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the texts' identifiers in ascending order of documents; (part, seq, path, ...) of each file.

    Documents are dealt to tasks by ranges of identifiers, so a task's files follow
    those of the task before.  Rows with one identifier are ordered by a hash of the
    text, null identifiers come first, null texts count as empty.  The library sees
    every different part between white space, at which its tokens never join.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        ids: list[int | None] = []
        held: list[bytes] = []
        seq = size = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, held, size, seq
            values = np.frombuffer(b"".join(held), "<u4")
            lengths = np.array([len(h) // 4 for h in held], np.int64)
            shard = Shard(ids, lengths, WaveletMatrix.build(values, encoder.levels))
            path = task_file(folder, ".wvl")
            with create(path) as out:
                out.write(shard.dump())
            row = {"part": part, "seq": seq, "path": path, "documents": len(ids), "tokens": size}
            ids, held, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for piece in pieces(batch):
                names = piece.column(0).to_pylist()
                for name, made in zip(names, encoder.encode(piece.column(1)), strict=True):
                    ids.append(name)
                    held.append(made)
                    size += len(made) // 4
                    if size >= shard_tokens:
                        yield close()
        if ids:
            yield close()

    shards = ordered.mapInArrow(
        run, "part long, seq long, path string, documents long, tokens long"
    )
    return stored(shards, "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files that ``shards`` lists."""
    return _read(shards, "ids binary", lambda ids: pa.array([i.tobytes() for i in ids], pa.binary()))


def shard_digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    return _read(
        shards, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())
    )


def _read(shards: DataFrame, kind: str, column) -> DataFrame:
    """One row for each document; ``start`` counts the tokens of all documents before it.

    The running sum is over one row for each file, of some million tokens, not over
    documents.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("begin")
    placed = stored(shards.select("path", begin), "placed")
    n = max(1, placed.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with reader(path) as file:
                    shard = Shard.load(file.read())
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                values = shard.matrix.values().astype("<u4")
                for at in range(0, len(ends), 2_000):
                    span = slice(at, at + 2_000)
                    ids = [values[a:b] for a, b in zip(starts[span], ends[span], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[span], pa.int64()),
                            pa.array(starts[span] + begin),
                            pa.array(shard.lengths[span]),
                            column(ids),
                        ],
                        names=["doc_id", "start", "n_tokens", kind.split()[0]],
                    )

    return placed.repartition(n).mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind}")


def token_digests(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the files to the shared folder and read them back; see :func:`shard_digests`."""
    folder = new_folder(docs.sparkSession, "tokens")
    return shard_digests(write_shards(docs, folder, tokenizer, doc_id, text))
