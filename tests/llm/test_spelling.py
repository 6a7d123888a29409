import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from check_oracle import rows_of
from samples import SF, docs, no_docs, odd_docs  # noqa: F401

from textlode.llm import queries, spelling

LETTERS = "[A-Za-zÀ-ÿ]+"


def plain_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall(LETTERS, text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    found, forms = {}, {}
    for word, n in counts.items():
        others = [w for w in counts if near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        forms[word] = form
        found[word] = (form, n, len(others), None if form is None else counts[form])
    rows = set()
    for word, (form, n, n_near, form_n) in found.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        rows.add((word, form, root, n, n_near, form_n))
    return rows


def invented(n, seed=1):
    """Words over few letters, so that many are near, and their variants."""
    rng = random.Random(seed)
    words = {}
    for _ in range(n):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(6, 9)))
        words[word] = rng.choice([5, 6, 30, 200, 5000])
    return words


@pytest.mark.parametrize("cell,block,leaf", [(8192, 32768, 32), (40, 25, 4), (10, 6, 1)])
def test_variants_equal_brute_force(spark, monkeypatch, cell, block, leaf):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    counts = invented(400)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling.variants(words).collect()
    assert len(found) == len(counts)
    assert {tuple(r) for r in found} == plain_variants(counts)
    assert any(r.root != (r.form or r.word) for r in found)


def test_anagrams_share_a_vector(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL_WORDS", 20)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 10)
    rng = random.Random(3)
    counts = {"".join(rng.sample("aabbccdd", 8)): 5 + i for i in range(150)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(words).collect()} == plain_variants(counts)


def test_one_edit_is_within_the_radius():
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("abzé÷ÿ") for _ in range(8))
        at, letter = rng.randrange(8), rng.choice("abqé")
        vector = lambda w: spelling.vectors_of(spelling.letters_of([w], len(w)))
        apart = lambda w: int(np.abs(vector(w) - vector(word)).sum())
        assert apart(word[:at] + word[at + 1 :]) == 1
        assert apart(word[:at] + letter + word[at:]) == 1
        assert apart(word[:at] + letter + word[at + 1 :]) <= 2


def test_pieces_of_long_texts_keep_runs_whole(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE_CHARS", 7)
    text = "Abcdéfgh ij×kl, MNOPQRÉstu vwxyz  abcdefghijklmnopqrstuvwxyz end"
    runs = [r for part in spelling.runs_of(text) for r in part]
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    assert runs == re.findall(LETTERS, lower)


def test_whole_query_equals_brute_force(spark, docs):  # noqa: F811
    counts = plain_counts((r.doc_id, r.text) for r in docs.collect())
    counted = spelling.word_counts(docs).collect()
    assert {r.word: r.n for r in counted} == counts


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.op11_spelling_variants(spark, SF)
    result = duck.execute(queries.oracle_sql()["op11_spelling_variants"])
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    assert want and rows_of(df.columns, df.collect()) == want


def test_odd_and_empty_tables(spark, odd_docs, no_docs):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = spelling.document_variants(odd_docs.unionAll(odd_docs).unionAll(odd_docs))
    counts = plain_counts(rows * 3)
    assert counts and {tuple(r) for r in found.collect()} == plain_variants(counts)
    assert spelling.document_variants(no_docs).collect() == []
