import math
import random

import brute
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from textlode import Analyzer, TermIndex
from textlode.functions.stopwords import load_stopwords
from textlode.operators import ranking as rk
from textlode.operators import statistics as st
from textlode.plans.sizing import is_small, join_tokens, keep_listed

STOP = set(load_stopwords())
WORDS = ["rust", "lang", "happy", "search", "engine", "sky", "42", "the", ",", "indexer"]


def random_texts(seed, n=12):
    rng = random.Random(seed)
    texts = {i: " ".join(rng.choices(WORDS, k=rng.randint(0, 14))) for i in range(n)}
    texts[n] = "the"
    return texts


def scores(df):
    return {r.doc_id: round(r.score, 6) for r in df.collect()}


def idf_of(corpus, texts, mode, token):
    index = TermIndex.from_documents(corpus(texts), mode)
    row = index.stats.where(F.col("token") == token).head()
    return row and row.idf


@pytest.mark.parametrize(
    ("with_token", "mode", "idf"),
    [
        (2, "float", math.log(2.5)),
        (2, "pruned", math.log(2)),
        (3, "float", math.log(5 / 3)),
        (3, "pruned", None),
        (5, "float", 0.0),
        (5, "pruned", None),
    ],
)
def test_idf(corpus, with_token, mode, idf):
    texts = ["zig"] * with_token + ["rust"] * (5 - with_token)
    found = idf_of(corpus, texts, mode, "ZIG")
    assert found == (None if idf is None else pytest.approx(idf))


def test_total_documents(corpus):
    docs = st.document_table(corpus(["rust", "the", ""]), Analyzer())
    assert st.total_documents(docs, "float").head().n_docs == 3
    assert st.total_documents(docs, "pruned").head().n_docs == 1
    with pytest.raises(ValueError):
        st.total_documents(docs, "other")


@pytest.mark.parametrize("by_document", [True, False])
def test_term_frequency(corpus, by_document):
    docs = corpus(["ab cd ab", "ab"])
    rows = st.term_frequency(docs, Analyzer(), by_document=by_document).collect()
    assert sorted(tuple(r) for r in rows) == [(0, "AB", 2), (0, "CD", 1), (1, "AB", 1)]


def test_lookup_tf(spark, corpus):
    postings = st.term_frequency(corpus(["ab ab"]), Analyzer())
    pairs = spark.createDataFrame([(0, "AB"), (0, "CD"), (9, "AB")], "doc_id long, token string")
    found = st.lookup_tf(pairs, postings).collect()
    assert sorted(tuple(r) for r in found) == [(0, "AB", 2), (0, "CD", 0), (9, "AB", 0)]


@pytest.mark.parametrize("mode", st.MODES)
@pytest.mark.parametrize("query", ["rust sky", "happy happy rust 42", "engine , search"])
def test_query_equals_model(corpus, mode, query):
    for seed in (1, 2):
        texts = random_texts(seed)
        index = TermIndex.from_documents(corpus(texts), mode)
        tokens = rk.query_tokens(index.postings.sparkSession, query, index.analyzer)
        assert scores(index.query(tokens)) == pytest.approx(
            brute.search(texts, query, STOP, mode)
        )


def test_query_rules(corpus):
    texts = ["rust lang", "rust", "zig zag", "gopher"]
    index = TermIndex.from_documents(corpus(texts))
    once, twice = index.search("rust"), index.search("rust rust")
    assert scores(once) == scores(twice) != {}
    assert index.search("").collect() == []
    assert index.search("the and").collect() == []
    assert index.search("rust qqq").collect() == []
    pruned = TermIndex.from_documents(corpus(texts), "pruned")
    assert scores(pruned.search("rust qqq")) == scores(pruned.search("rust")) != {}
    lenient = TermIndex.from_documents(corpus(texts), require_all_known=False)
    assert scores(lenient.search("rust qqq")) == scores(once)


def test_top_n(corpus):
    index = TermIndex.from_documents(corpus(random_texts(3)))
    tokens = rk.query_tokens(index.postings.sparkSession, "rust sky", index.analyzer)
    full = index.query(tokens).collect()
    for n in (0, 1, 3, 100):
        assert index.query_top_n(tokens, n).collect() == full[:n]
    assert [r.score for r in full] == sorted((r.score for r in full), reverse=True)


@pytest.mark.parametrize("mode", st.MODES)
@pytest.mark.parametrize("max_rows", [1_000_000, 0])
def test_batch_equals_single_queries(spark, corpus, mode, max_rows):
    texts = random_texts(4, 30)
    index = TermIndex.from_documents(corpus(texts), mode)
    asked = [(1, "rust sky", 3), (2, "happy", 0), (3, "engine qqq", None), (4, "the", 5)]
    requests = spark.createDataFrame(asked, "query_id long, search string, top_n int")
    found = {}
    rows = index.search_batch(requests, max_rows=max_rows, hot_rows=2).collect()
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for query_id, search, top_n in asked:
        expected = [
            (i + 1, r.doc_id, r.score)
            for i, r in enumerate(index.search(search, top_n or 10).collect())
        ]
        assert sorted(found.get(query_id, [])) == expected


def test_salted_join_keeps_every_row(spark):
    """One token holds most rows; all three join plans agree."""
    postings = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("token"),
        F.lit(1).cast("long").alias("tf"),
    )
    lookup = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    plain = postings.join(lookup, "token")
    for sizes in ({}, {"max_rows": 5, "hot_rows": 100}, {"max_rows": 0}):
        joined = join_tokens(postings, lookup, **sizes)
        assert joined.count() == 3000
        assert joined.select(plain.columns).exceptAll(plain).count() == 0
    salted = join_tokens(postings, lookup, max_rows=5, hot_rows=100)
    assert "_salt" in plan_of(salted)


def test_is_small(spark):
    assert is_small(spark.range(10), 10) and not is_small(spark.range(11), 10)
    long = spark.createDataFrame([("x" * 100,), (None,)], "token string")
    assert is_small(long, 10, 116) and not is_small(long, 10, 115)
    assert "SinglePartition" in plan_of(long.agg(F.count("token")))


@pytest.mark.parametrize("max_rows", [10, 0])
def test_keep_listed_for_any_size(spark, max_rows):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "token string, n int")
    listed = spark.createDataFrame([("a",), ("a",), ("z",)], "token string")
    kept = keep_listed(rows, listed, "token", max_rows)
    assert sorted(r.n for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("limit", [1000, 2])
def test_sizes_are_bounded_request_by_request(spark, monkeypatch, limit):
    monkeypatch.setattr(rk, "LIMIT_ROWS", limit)
    scores = spark.range(50).select(
        (F.col("id") % 5).alias("query_id"), F.col("id").alias("doc_id"),
        (F.col("id") % 7).cast("double").alias("score"),
    )
    sizes = {0: 1, 1: 8, 2: None, 3: -4, 4: 0, 9: 3}
    requests = spark.createDataFrame(list(sizes.items()), "query_id long, top_n int")
    found = {}
    for r in rk.top_per_query(scores, requests).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    for q, n in {0: 1, 1: 8, 2: 10, 3: 1, 4: 10}.items():
        mine = sorted(range(q, 50, 5), key=lambda i: (-(i % 7), i))[:n]
        assert sorted(found[q]) == list(enumerate(mine, 1))
    assert 9 not in found


def test_common_token_in_every_request(spark, corpus):
    """One token in all documents and requests; a salted join makes the same rows."""
    texts = [f"rust {w}" for w in ("aa", "bb", "aa cc", "dd") * 5]
    index = TermIndex.from_documents(corpus(texts), "float")
    asked = [(i, f"rust {w}", 4) for i, w in enumerate(("aa", "bb", "cc", "rust"))]
    requests = spark.createDataFrame(asked, "query_id long, search string, top_n int")
    plain = sorted(index.search_batch(requests).collect())
    assert plain == sorted(index.search_batch(requests, max_rows=0, hot_rows=3).collect())
    assert {r.query_id for r in plain} == {0, 1, 2}


def test_format(spark):
    rows = spark.createDataFrame([(7, 1234.5678)], "doc_id long, score double")
    assert rk.format_results(rows).collect()[0].asDict() == {
        "docId": 7,
        "score": 1234.5678,
        "score_text": "1234.57",
    }
    assert rk.results_json(rows).head().response == '{"docId":7,"score":1234.5678}'


def test_plans(spark, corpus):
    index = TermIndex.from_documents(corpus(random_texts(5)))
    top = plan_of(index.search("rust sky", 5))
    assert "TakeOrderedAndProject" in top and "BroadcastHashJoin" in top
    requests = spark.createDataFrame([(1, "rust", 2)], "query_id long, search string, top_n int")
    batch = plan_of(index.search_batch(requests))
    assert "WindowGroupLimit" in batch
    for plan in (top, batch):
        assert "Python" not in plan
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_counting_needs_one_shuffle(corpus):
    plan = plan_of(st.term_frequency(corpus(["a b"]), Analyzer()))
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_words_first_counts_the_same(corpus):
    docs = corpus(random_texts(6))
    plain = st.term_frequency(docs, Analyzer())
    first = st.term_frequency(docs, Analyzer(), words_first=True)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, first.collect()))
