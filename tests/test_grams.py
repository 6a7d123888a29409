"""n-grams counted as numbers against the row form."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textlode import Analyzer
from textlode.functions import grams
from textlode.operators import statistics as st

TEXTS = [
    (1, "The factory's dairy: straße, ÉCLAIRS and naïveté 12345678 "),
    (2, "abcdefghij abcdefg abc abcd abcdef aaaaaaaaaa aaa"),
    (2, "abc abcdefg zebra"),  # a document's second row
    (3, ""), (4, "   "), (5, None), (None, "zebra zebras"), (None, "zebra"),
    (6, "𐐷𐐷𐐷𐐷𐐷 𐐷𐐷𐐷 日本語の文章です πρόσωπον"), (7, "and the of"), (8, "x"),
]


def counts(df):
    return Counter(tuple(r) for r in df.select("doc_id", "token", "tf").collect())


@pytest.mark.parametrize("sizes", [(3, 5, 7), (), (1,), (2, 2, 12)])
def test_numbered_counts_are_those_of_rows(spark, sizes):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    analyzer = Analyzer(gram_sizes=sizes)
    numbered = st.term_frequency(docs, analyzer, numbered=True)
    assert "MapInArrow" in plan_of(numbered)
    assert counts(numbered) == counts(st.term_frequency(docs, analyzer))


def test_an_own_analysis_keeps_the_row_form(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for own in (Analyzer(mode="bytes"), Analyzer(stemmer=lambda t: F.substring(t, 1, 4))):
        numbered = st.term_frequency(docs, own, numbered=True)
        assert "MapInArrow" not in plan_of(numbered)
        assert counts(numbered) == counts(st.term_frequency(docs, own))


def test_document_frequency_makes_no_row_for_each_gram(spark):
    plan = plan_of(entry.document_frequency(spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in plan and "Generate" not in plan


def test_documents_stay_whole(monkeypatch):
    monkeypatch.setattr(grams, "CHUNK_WORDS", 10)
    sizes = [3, 3, 40, 0, 1, 9, 2, 2, 30, 5]
    keys = ["a", "a", "b", "c", "c", "d", None, None, "e", "e"]
    batch = pa.record_batch([keys, pa.array(sizes, pa.int32())], names=["doc_id", "n"])
    parts = [(batch.slice(i, 2)) for i in range(0, 10, 2)]
    chunks = list(grams.whole_documents(iter(parts), "doc_id"))
    seen = [key for chunk in chunks for key in dict.fromkeys(chunk["doc_id"].to_pylist())]
    assert seen == ["a", "b", "c", "d", None, "e"]
    assert sum(pc["n"].to_numpy().sum() for pc in chunks) == sum(sizes)


def test_large_alphabets_are_told_apart():
    """Seven letters of so many kinds do not fit one number; equal numbers would mix n-grams."""
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    words = list(dict.fromkeys("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(900)))
    words += ["".join(letters)]
    first, token, often, tokens = grams.word_grams(pa.array(words), ((3, 1), (7, 2)))
    names = tokens.to_pylist()
    assert len(names) == len(set(names))
    for i, word in enumerate(words):
        wanted = Counter([word])
        for size, times in ((3, 1), (7, 2)):
            wanted.update({g: n * times for g, n in Counter(
                word[j : j + size] for j in range(len(word) - size)).items()})
        at = range(first[i], first[i + 1])
        assert {names[token[k]]: int(often[k]) for k in at} == dict(wanted)


def test_sums_of_large_keys():
    keys, weights = np.array([2**62, 5, 2**62, 5]), np.array([1, 2, 3, 2**20])
    assert [list(x) for x in grams._summed(keys, weights)] == [[5, 2**62], [2 + 2**20, 4]]


WORDS = [
    (1, 0, [("BANANA", 2), ("BAN", 1)]), (1, 0, [("RUST\nBANANA", 1)]), (1, 3, [("BANANAS", 4), ("", 2)]),
    (2, 0, [("ANANAS", 1), (None, 3)]), (None, 0, [("BANANA", 1)]), (3, 5, []), (4, 5, [("￿X", 1)]),
]


def given_words(spark):
    schema = "doc_id long, ord long, terms array<struct<token: string, tf: long>>"
    rows = spark.createDataFrame(WORDS, schema).repartition(3, "doc_id")
    return rows.sortWithinPartitions("doc_id", "ord")


def expected_terms():
    """{(doc, ord): Counter of tokens}, by hand."""
    found = {}
    for doc, order, terms in WORDS:
        tokens = found.setdefault((doc, order), Counter())
        for word, tf in terms:
            cut = [word] if word is None else [word] + [
                word[i : i + n] for n in (3, 5) for i in range(len(word) - n)
            ]
            for token in cut:
                tokens[token] += tf
    return found


@pytest.mark.parametrize("chunk", [1, 300_000])
def test_stored_words_are_counted_as_numbers(spark, monkeypatch, chunk):
    monkeypatch.setattr(grams, "CHUNK_WORDS", chunk)
    found, rows = expected_terms(), given_words(spark)
    each = Counter(tuple(r) for r in grams.counted_terms(rows, (3, 5), latest=False).collect())
    assert each == Counter((d, t, n, o) for (d, o), tokens in found.items() for t, n in tokens.items())
    latest = {}
    for (doc, order), tokens in sorted(found.items(), key=lambda kv: kv[0][1]):
        latest |= {(doc, token): (n, order) for token, n in tokens.items()}
    kept = Counter(tuple(r) for r in grams.counted_terms(rows, (3, 5)).collect())
    assert kept == Counter((d, t, n, o) for (d, t), (n, o) in latest.items())
    df = grams.counted_documents(rows, (3, 5)).groupBy("token").agg(F.sum("n")).collect()
    assert Counter(dict(map(tuple, df))) == Counter(t for _, t in latest)


def test_tokens_of_words_are_made_once(spark):
    words = spark.createDataFrame([("AAAAAA",), ("BAN",), ("",), (None,)], "word string")
    rows = grams.word_tokens(words, (3, 5)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        ("AAAAAA", "AAAAAA", 1), ("AAA", "AAAAAA", 3), ("AAAAA", "AAAAAA", 1), ("BAN", "BAN", 1),
        ("", "", 1), (None, None, 1),
    ], key=str)
