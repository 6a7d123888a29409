"""BPE encoding and decoding with a tokenization automaton.

The merges of a vocabulary file are compiled, one gadget after another, into a
deterministic automaton whose arcs are tokens and whose paths are exactly the
tokenizations the merges give.  A word is encoded by following the one path that
spells it; identifiers are decoded by writing the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import Memo, append_columns, kept, slices, texts_of

#: White space between words; of these only ``str.split`` would also split at \x1c-\x1f.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
CONTROLS = "\x1c\x1d\x1e\x1f"
MEMO_WORDS = 300_000
#: Remembered beginnings of words, and the longest word that is looked up by them.
PATH_STATES = 150_000
PATH_CHARS = 48
#: Symbols at the end of a word that bound the length of its last label.
TAIL = 3
#: Marks that are a word of their own behind letters.
MARKS = ".,;:!?"
#: Texts are handled about so many code points at a time.
SLICE_CHARS = 2_000_000


def chunks_of(text: str) -> list[str]:
    """Parts of a text between white space; no token reaches over white space."""
    if any(c in text for c in CONTROLS):
        return [c for c in SPACE.split(text) if c]
    return text.split()


class Automaton:
    """Deterministic automaton over tokens, built from merges in their order.

    All arcs with one label lead to one state.  The gadget of a merge (a, b), where
    the state behind ``a`` has an arc ``b``: that state loses the arc ``b``, and every
    state with an arc ``a`` gets an arc ``ab`` to where the arc ``b`` led.  The state
    behind ``ab`` thus starts as the state behind ``b`` is at that time.  So a state
    is stored as its difference: ``lost`` has for a label the arcs taken away with
    their time, ``parts`` where a label came from and when.
    """

    def __init__(self, base: Sequence[str], merges: Sequence[tuple[str, str]]):
        self.time: dict[str, int] = dict.fromkeys(base, -1)
        self.parts: dict[str, tuple[str, str]] = {}
        self.lost: dict[tuple[str, str], int] = {}
        self._arcs: dict[tuple[str, str], bool] = {}
        for now, (a, b) in enumerate(merges):
            label = a + b
            if a not in self.time or b not in self.time or not self.has_arc(a, b, now):
                continue
            self.lost[a, b] = now
            if label not in self.time:
                self.time[label] = now
                self.parts[label] = (a, b)
        self.longest = max(map(len, self.time), default=1)

    def has_arc(self, state: str, label: str, now: int | None = None) -> bool:
        """Whether the state behind ``state`` has an arc ``label``, at a time or at last."""
        # Half a step apart: the arcs a merge takes are gone before it gives new ones.
        until = float("inf") if now is None else now
        time, parts, lost = self.time, self.parts, self.lost
        while True:
            gone = lost.get((state, label))
            if gone is not None and gone < until:
                return False
            born, made = time[state], time[label]
            if made >= born and made >= 0:
                # The arc came to this state with its first part.
                until = made + 0.5
                label = parts[label][0]
            elif born >= 0:
                # This state began as a copy of the one behind its second part.
                until = born
                state = parts[state][1]
            else:
                return True

    def arc(self, state: str, label: str) -> bool:
        """The same from the table of arcs that were asked for."""
        key = (state, label)
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) > 300_000:
                self._arcs.clear()
            self._arcs[key] = found = self.has_arc(state, label)
        return found

    def path(self, symbols: Sequence[str]) -> list[str]:
        """Labels of the one path that spells the symbols.

        Each beginning of a word has one path; its last arc is found among the tokens
        that end there and leave a state the automaton reaches.
        """
        n = len(symbols)
        word = "".join(symbols)
        at = [0]
        for s in symbols:
            at.append(at[-1] + len(s))
        last: list[str] = [""] * (n + 1)
        origin = [0] * (n + 1)
        time, arc = self.time, self.arc
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                label = word[at[start] : at[end]]
                if label in time and (start == 0 or (last[start] and arc(last[start], label))):
                    last[end], origin[end] = label, start
                    break
        labels = []
        end = n
        while end:
            if not last[end]:
                raise ValueError("a symbol of the word is not in the vocabulary")
            labels.append(last[end])
            end = origin[end]
        return labels[::-1]


class WordPaths:
    """Paths of words of one-character symbols with an end behind the last.

    The state of the automaton behind the beginning of a word is remembered, so
    words that begin alike share their transitions.
    """

    def __init__(self, automaton: Automaton, end: str):
        self.automaton, self.end = automaton, end
        self.states: dict[str, str] = {}
        #: Length of the longest label that ends in three symbols, by what stands behind it.
        self.reach: dict[str, dict[str, int]] = {"": {}, end: {}}
        for stop, reach in self.reach.items():
            for label in automaton.time:
                if label.endswith(stop):
                    own = label[: len(label) - len(stop)]
                    if len(own) > TAIL:
                        reach[own[-TAIL:]] = max(len(own), reach.get(own[-TAIL:], 0))

    def step(self, word: str, stop: str = "") -> str:
        """Last label of the path that spells ``word`` and ``stop``; shorter words are known."""
        states, time = self.states, self.automaton.time
        n = len(word)
        # No longer label ends like the word.
        longest = self.reach[stop].get(word[-TAIL:], TAIL)
        for start in range(max(0, n - longest), n):
            label = word[start:] + stop
            if label in time and (
                not start or self.automaton.arc(states[word[:start]], label)
            ):
                return label
        raise ValueError("a symbol of the word is not in the vocabulary")

    def path(self, word: str) -> list[str]:
        n = len(word)
        if n > PATH_CHARS:
            return self.automaton.path([*word[:-1], word[-1] + self.end])
        states = self.states
        if len(states) > PATH_STATES:
            states.clear()
        known = n - 1
        while known and word[:known] not in states:
            known -= 1
        for at in range(known + 1, n):
            states[word[:at]] = self.step(word[:at])
        label = self.step(word, self.end)
        labels, at = [label], n - len(label) + len(self.end)
        while at:
            label = states[word[:at]]
            labels.append(label)
            at -= len(label)
        return labels[::-1]


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in kept}
    others = (b for b in range(256) if b not in letters)
    return [
        letters[b] if b in letters else letters.setdefault(b, chr(256 + i))
        for b, i in sorted(
            [(b, 0) for b in kept] + [(b, i) for i, b in enumerate(others)]
        )
    ]


class Codec:
    """Encoder and decoder for a vocabulary file of BPE over bytes with word ends.

    The file must ask for NFC, single spaces, lower case, the split by a pattern,
    bytes as letters and merges with a word end; no padding, no truncation.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec["decoder"]:
            raise ValueError("the vocabulary file asks for other steps than this encoder has")
        split, _ = spec["pre_tokenizer"]["pretokenizers"]
        self.steps = Tokenizer.from_file(path)
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        letters = byte_letters()
        base = [s for c in letters for s in (c, c + self.end) if s in self.ids]
        self.automaton = Automaton(base, merges)
        self.labels = {i: token for token, i in (self.ids | self.added).items()}
        self.paths = WordPaths(self.automaton, self.end)
        self.memo = Memo(self.encode_chunks, MEMO_WORDS)
        self.seen = Memo(self.encode_words, MEMO_WORDS)

    def words(self, text: str) -> list[str]:
        """Pre-split words, a letter for each byte.

        Code points newer than Python's tables are split by the library's own steps,
        which know another version of Unicode.
        """
        if not text.isascii() and "Cn" in map(unicodedata.category, text):
            text = self.steps.normalizer.normalize_str(text)
            return [word for word, _ in self.steps.pre_tokenizer.pre_tokenize_str(text)]
        text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        letters = byte_letters()
        found = self.pattern.findall(text)
        return ["".join([letters[b] for b in word.encode("utf-8")]) for word in found]

    def segment(self, text: str) -> bytes:
        """Identifiers of a text without special tokens and white space."""
        words = self.words(text)
        self.seen.learn(words)
        return b"".join(map(self.seen.look, words))

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """Identifiers of pre-split words, by the automaton."""
        path, ids = self.paths.path, self.ids
        return [array("I", [ids[label] for label in path(word)]).tobytes() for word in words]

    def chunk(self, chunk: str) -> bytes:
        """Identifiers of a text without white space, as the bytes of an array of uint32."""
        if self.special is None or self.special.search(chunk) is None:
            return self.segment(chunk)
        parts, at = [], 0
        for match in self.special.finditer(chunk):
            parts.append(self.segment(chunk[at : match.start()]))
            parts.append(array("I", [self.added[match[0]]]).tobytes())
            at = match.end()
        return b"".join([*parts, self.segment(chunk[at:])])

    def encode_chunks(self, chunks: Sequence[str]) -> list[bytes]:
        """Identifiers of each chunk; letters with or without a mark share theirs."""
        plain: list[tuple[str, str]] = []
        letters = byte_letters()
        for chunk in chunks:
            mark = chunk[-1] if chunk[-1] in MARKS else ""
            word = chunk[:-1] if mark else chunk
            known = word.isascii() and word.isalpha()
            plain.append((word.lower(), mark) if known else ("", chunk))
        # The letter of a plain letter's byte is that letter.
        marks = {m: letters[ord(m)] for m in MARKS}
        self.seen.learn([word for word, _ in plain if word], marks.values())
        look = self.seen.look
        simple = [
            (look(w) + look(marks[m]) if m else look(w)) if w else None for w, m in plain
        ]
        return [
            self.chunk(rest) if made is None else made
            for made, (_, rest) in zip(simple, plain, strict=True)
        ]

    def encode(self, text: str) -> np.ndarray:
        chunks = chunks_of(text)
        self.memo.learn(chunks)
        return np.frombuffer(b"".join(map(self.memo.look, chunks)), "<u4")

    def encode_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        found = []
        for a, b in slices(texts, SLICE_CHARS):
            chunks = [chunks_of(text) for text in texts[a:b]]
            self.memo.learn(*chunks)
            look = self.memo.look
            found += [np.frombuffer(b"".join(map(look, one)), "<u4") for one in chunks]
        return found

    def decode(self, ids: Sequence[int]) -> str:
        """Labels of the identifiers, joined by one space; unknown identifiers are left out."""
        try:
            return " ".join(map(self.labels.__getitem__, ids))
        except KeyError:
            return " ".join(self.labels[i] for i in ids if i in self.labels)


def codec(path: str) -> Codec:
    """The codec of a worker for a file, compiled once and kept while it serves this operator."""
    return kept(__name__, path, lambda: Codec(path))


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the identifiers of the whole text as ARRAY<INT>.

    Null, empty and blank texts give an empty array.  All columns and rows stay.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        found = codec(path).encode_batch(texts_of(batch, text))
        ends = np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))
        flat = np.concatenate([*found, np.zeros(0, "<u4")]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]

    return append_columns(docs, compute, [(name, T.ArrayType(T.IntegerType()))])


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array of identifiers; a null array gives an empty text."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        own = codec(path)
        column = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        return [pa.array([own.decode(i or ()) for i in column], pa.string())]

    return append_columns(rows, compute, [(name, T.StringType())])


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded in one pass.

    The digests are of the decimal identifiers joined by one space and of the decoded
    text in UTF-8.  Null texts count as empty; repeated rows are each returned.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        own = codec(path)
        look = _decimals().__getitem__
        sizes, ids_sha, decoded_sha = [], [], []
        for ids in own.encode_batch(texts_of(batch, text)):
            numbers = ids.tolist()
            sizes.append(len(numbers))
            ids_sha.append(hashlib.sha256(" ".join(map(look, numbers)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(own.decode(numbers).encode("utf-8")).hexdigest())
        return [pa.array(sizes, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [
        ("n_tokens", T.LongType()),
        ("ids_sha256", T.StringType()),
        ("decoded_sha256", T.StringType()),
    ]
    return append_columns(source, compute, fields).drop("text")


class _Decimals(dict):
    def __missing__(self, number: int) -> str:
        self[number] = text = str(number)
        return text


@lru_cache(maxsize=1)
def _decimals() -> dict[int, str]:
    return _Decimals()
