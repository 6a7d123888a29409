import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from samples import ODD, SF, docs, no_docs, odd_docs  # noqa: F401

from textlode.llm import bpe, wavelet
from textlode.llm.queries import TOKENIZER, op7_token_ids, op9_bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def digests(library, i, text):
    ids = ids_of(library, text)
    decoded = library.decode(ids, skip_special_tokens=False)
    return (
        i,
        len(ids),
        hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def placed(library, rows):
    start, out = 0, []
    for i, text in rows:
        ids = [*ids_of(library, text), 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_automaton_on_small_merges():
    merges = [("a", "a"), ("aa", "b"), ("b", "a"), ("a", "ba"), ("aa", "aa")]
    machine = bpe.Automaton("ab", merges)
    rng = random.Random(1)
    for _ in range(3000):
        word = [rng.choice("ab") for _ in range(rng.randrange(1, 14))]
        parts = list(word)
        while True:  # the pair of the earliest merge, leftmost first
            found = [
                (merges.index(p), i)
                for i, p in enumerate(zip(parts, parts[1:], strict=False))
                if p in merges
            ]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
        assert machine.path(word) == parts, word


def test_encoding_and_decoding_equal_the_library(library):
    codec = bpe.codec(TOKENIZER)
    rng = random.Random(3)
    letters = (
        "aabcdehilmnorstABCST0123'.,!-éÉßΣσİǅﬁ̈你"
        "好\U0001f600한½²Ⅷ​ͅ٣ \t\n\x1c\x1f\x85  　<|>"
    )
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    texts += [
        "".join(chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0x10000, 0x12000)])) for _ in range(20))
        for _ in range(600)
    ]
    texts += ["it's I'LL we've", "a<|endoftext|>b <|startoftext|>", "ΟΔΟΣ.", "l" * 300]
    texts += [t or "" for _, t in ODD]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids.tolist() == ids_of(library, text), text[:80]
        assert codec.decode(ids.tolist()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_op9_equals_the_library(spark, docs, library):
    want = {digests(library, r.doc_id, r.text) for r in docs.collect()}
    assert {tuple(r) for r in op9_bpe(spark, SF).collect()} == want


def test_op9_odd_texts(odd_docs, no_docs, library):
    got = bpe.digests(odd_docs, TOKENIZER).collect()
    want = [digests(library, i, t) for i, t in ODD]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(no_docs, TOKENIZER).collect() == []
    coded = bpe.decode(bpe.encode(odd_docs, TOKENIZER), TOKENIZER)
    assert coded.columns == [*odd_docs.columns, "ids", "decoded"]
    for r in coded.collect():
        assert r.ids == ids_of(library, r.text)


def test_encoder_of_token_files_equals_the_library(library):
    rng = random.Random(5)
    encoder = wavelet._Encoder(TOKENIZER)
    ends = ["", "'", "...", "$$$", "'s", "<|", ".!!"]
    texts = [chr(c) + "a." for c in range(0x20, 0x3000)] + ["a" + chr(c) + "'" for c in range(0x20, 0x3000)]
    texts += [
        " ".join(
            "".join(chr(rng.randrange(0x20, 0x260)) for _ in range(rng.randrange(1, 9))) + rng.choice(ends)
            for _ in range(8)
        )
        for _ in range(2000)
    ]
    texts += ["", None, " ", "it's dogs' a<|endoftext|>b.", "абв. где!! ΟΔΟΣ.", "Ab" * 300, "İstanbul.\u0301"]
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*ids_of(library, text), 1], text
    assert encoder.encode(pa.array([], pa.string())) == []


def test_op7_equals_the_library(spark, docs, library):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(map(tuple, op7_token_ids(spark, SF).collect()))
    assert got == placed(library, rows)


def test_op7_odd_texts_in_small_shards(odd_docs, no_docs, library, tmp_path):
    shards = wavelet.write_shards(odd_docs, str(tmp_path), TOKENIZER, shard_tokens=10)
    assert shards.count() > 4
    got = sorted(map(tuple, wavelet.shard_digests(shards).collect()), key=lambda r: r[1])
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == placed(library, rows)
    ids = {r.start: np.frombuffer(r.ids, "<u4").tolist() for r in wavelet.read_shards(shards).collect()}
    assert ids[0] == [*ids_of(library, rows[0][1]), 1]
    assert wavelet.token_digests(no_docs, TOKENIZER).collect() == []


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 40, n).astype(np.uint32)
    shard = wavelet.Shard([5], np.array([n]), wavelet.WaveletMatrix.build(values, 6))
    matrix = wavelet.Shard.load(shard.dump()).matrix
    assert (matrix.values() == values).all()
    at = rng.integers(0, n, 50) if n else np.zeros(0, np.int64)
    assert (matrix.access(at) == values[at]).all()
    for value in (0, 1, 17, 39, 63, 64):
        where = np.flatnonzero(values == value)
        for end in (0, n // 3, n):
            assert matrix.rank(value, end) == (where < end).sum()
        for nth in (0, 1, len(where) - 1, len(where)):
            want = int(where[nth]) if 0 <= nth < len(where) else -1
            assert matrix.select(value, nth) == want


def test_damaged_token_file():
    data = bytearray(wavelet.Shard([1], np.array([9]), wavelet.WaveletMatrix.build(np.arange(9), 4)).dump())
    data[-1] ^= 1
    with pytest.raises(ValueError):
        wavelet.Shard.load(bytes(data))


def test_last_labels_are_sought_among_lengths_their_ending_has():
    """op9: a word is not asked for labels longer than any that ends like it."""
    merges = [("a", "b"), ("ab", "c"), ("abc", "d"), ("x", "abcd"), ("d", "e$")]
    machine = bpe.Automaton([*"abcdex", "e$", "d$", "c$"], merges)
    paths = bpe.WordPaths(machine, "$")
    assert paths.reach[""].get("bcd") == 5 and "bcx" not in paths.reach[""]
    for word in ("abcd", "xabcd", "abcde", "cde", "xabcc", "d", "abxabcde"):
        assert paths.path(word) == machine.path([*word[:-1], f"{word[-1]}$"])
