import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from check_oracle import rows_of
from samples import no_docs, odd_docs  # noqa: F401

from textlode.llm import collocation, queries

SF = "/root/testdata/sf0.01"


def plain(rows, least=100, most=5, top=2000):
    """Contract of the query, word by word."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, phrase), a in f.items():
        if a < least or len(phrase) < 2:
            continue
        cuts = [
            (1000 * a * n[lang] // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k)
            for k in range(1, len(phrase))
        ]
        score, k = min(cuts)
        found[lang, phrase] = (a, f[lang, phrase[:k]], f[lang, phrase[k:]], n[lang], score)
    dropped = set()
    for (lang, phrase), row in found.items():
        for k in range(2, len(phrase)):
            for i in range(len(phrase) - k + 1):
                inner = (lang, phrase[i : i + k])
                if row[0] >= found[inner][0]:
                    dropped.add(inner)
    out = set()
    for lang in {key[0] for key in found}:
        keys = [k for k in found if k[0] == lang and k not in dropped]
        keys.sort(key=lambda k: (-found[k][4], -found[k][0], " ".join(k[1]).encode()))
        out |= {(lang, i + 1, " ".join(k[1]), *found[k]) for i, k in enumerate(keys[:top])}
    return out


def invented(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "Über", "a", "of", "New", "York", "x\x00y", "café", "b-c", "\x1fz", "a'b"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(["new york city", "of the", *words]))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!\x0b"]))
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(parts)))
    return rows


@pytest.mark.parametrize("least,most,top", [(5, 5, 2000), (3, 4, 7), (8, 2, 3)])
def test_collocations_equal_brute_force(spark, least, most, top):
    rows = invented()
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = collocation.collocations(docs, least=least, most=most, top=top).collect()
    want = plain(rows, least, most, top)
    assert want and {tuple(r) for r in found} == want and len(found) == len(want)


def test_many_tries_dictionaries_and_chunks(spark, monkeypatch):
    for name, value in (("TRIE_PHRASES", 9), ("DICTIONARY_WORDS", 7), ("CHUNK", 16),
                        ("HELD_KEYS", 50), ("ENDS", 4), ("BLOCKS", 3)):
        monkeypatch.setattr(collocation, name, value)
    rows = invented(2, 30)
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = collocation.collocations(docs, least=4).collect()
    assert {tuple(r) for r in found} == plain(rows, 4)


def test_words_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(t for _, t in invented(3))
    whole = [w for part in collocation.words_of(text) for w in part]
    monkeypatch.setattr(collocation, "PIECE_BYTES", 10)
    parts = list(collocation.words_of(text))
    assert len(parts) > 50 and [w for part in parts for w in part] == whole


def test_trie_accepts_its_phrases_only():
    rng = np.random.default_rng(4)
    for depth in (1, 2, 3, 5):
        phrases = np.unique(rng.integers(1, 12, (200, depth)), axis=0)[::2]
        trie = collocation.DoubleArray(rng.permutation(phrases))
        ids = rng.integers(0, 13, 3000).astype(np.int32)
        at, row = trie.accepted(np.r_[ids, np.zeros(5, np.int32)], 3000)
        known = {tuple(p) for p in phrases.tolist()}
        want = [i for i in range(3000 - depth + 1) if tuple(ids[i : i + depth].tolist()) in known]
        assert at.tolist() == want
        assert all(trie.phrases[r].tolist() == ids[i : i + depth].tolist() for i, r in zip(at, row))


def test_scores_are_exact(spark):
    big = 3 * 10**12 + 7
    row = spark.createDataFrame([(big, 10**13 + 1, big + 5, big + 9)], "a long, n long, l long, r long")
    found = row.select(collocation._score(*(row[c] for c in "anlr")).alias("s")).head()["s"]
    assert found == 1000 * big * (10**13 + 1) // ((big + 5) * (big + 9))


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.op13_phrase_collocations(spark, SF)
    result = duck.execute(queries.oracle_sql()["op13_phrase_collocations"])
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    assert len(want) > 50 and rows_of(df.columns, df.collect()) == want


def test_odd_and_empty_tables(spark, odd_docs, no_docs):  # noqa: F811
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    found = {tuple(r) for r in collocation.collocations(odd_docs).collect()}
    assert found == plain(rows) and any(r[2] == "word word" for r in found)
    assert collocation.collocations(no_docs).collect() == []
    assert collocation.collocations(odd_docs.limit(2)).collect() == []
