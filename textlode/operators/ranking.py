"""Ranked retrieval: one query or a table of queries against an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.functions.text import in_list
from textlode.operators.analysis import Analyzer
from textlode.plans.sizing import BROADCAST_ROWS, is_small, join_tokens

DEFAULT_TOP_N = 10
SCORE_DIGITS = 6
#: Spark plans a group limit for bounds of up to so many rows (its default threshold).
LIMIT_ROWS = 1_000
#: Parts that the documents of a query with a larger size are ranked in first.
RANK_PARTS = 64


def query_tokens(spark: SparkSession, search: str, analyzer: Analyzer) -> list[str]:
    """Distinct tokens of one search text."""
    text = spark.createDataFrame([(search,)], "text string")
    return list(dict.fromkeys(row["token"] for row in analyzer.tokens(text).collect()))


def in_tokens(tokens: Sequence[str]) -> Column:
    return in_list("token", tokens)


def score_sum(matches: DataFrame, *keys: str) -> DataFrame:
    """Sum of tf * idf per key."""
    return matches.groupBy(*keys).agg(F.sum(F.col("tf") * F.col("idf")).alias("score"))


def positive_scores(scores: DataFrame) -> DataFrame:
    """Scores above zero, rounded.

    Sums of doubles depend on the order of addition, so scores are rounded
    before anything is ranked by them.
    """
    kept = scores.where((F.col("score") > 0) & ~F.isnan("score"))
    return kept.withColumn("score", F.round("score", SCORE_DIGITS))


def match_query_tokens(postings: DataFrame, stats: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Postings of the query's tokens with their idf.

    The token list is a literal, so the filter reaches the Parquet scan; the
    statistics side has at most one row per query token and is broadcast.
    """
    wanted = in_tokens(tokens)
    few = stats.where(wanted).select("token", "idf")
    return postings.where(wanted).join(F.broadcast(few), "token")


def query(
    postings: DataFrame,
    stats: DataFrame,
    tokens: Sequence[str],
    require_all_known: bool = False,
) -> DataFrame:
    """All matching documents (doc_id, score), unordered.

    Each distinct token counts once.  With ``require_all_known`` one token
    without statistics empties the result.
    """
    distinct = list(dict.fromkeys(tokens))
    scores = positive_scores(
        score_sum(match_query_tokens(postings, stats, distinct), "doc_id")
    )
    if require_all_known and distinct:
        # Looks at df, so it reads what the scoring branch reads and can share
        # its shuffles.
        known = stats.where(in_tokens(distinct)).agg(F.count(F.when(F.col("df") > 0, 1)))
        scores = scores.where(known.scalar() == len(distinct))
    return scores


def ranked(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("score"), F.asc("doc_id"))


def query_top_n(scores: DataFrame, n: int) -> DataFrame:
    """First ``n`` of the ranking; ties by document."""
    return ranked(scores).limit(n)


def effective_top_n(top_n: Column) -> Column:
    """Missing or zero request sizes mean the default, negative ones the best row."""
    return (
        F.when(top_n.isNull() | (top_n == 0), F.lit(DEFAULT_TOP_N))
        .when(top_n < 0, F.lit(1))
        .otherwise(top_n)
    )


def request_tokens(requests: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Distinct (query_id, token) of requests (query_id, search, top_n)."""
    texts = requests.select("query_id", F.col("search").alias("text"))
    return analyzer.tokens(texts, "query_id").distinct()


def known_request_tokens(
    wanted: DataFrame, stats: DataFrame, require_all_known: bool = False
) -> DataFrame:
    """(query_id, token, df, idf) of the request tokens that have statistics."""
    if not require_all_known:
        return wanted.join(stats.select("token", "df", "idf"), "token")
    looked_up = wanted.join(stats.select("token", "df", "idf"), "token", "left")
    complete = (
        looked_up.groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count("df").alias("known"))
        .where("n = known")
        .select("query_id")
    )
    return looked_up.join(complete, "query_id", "left_semi")


def search_batch(
    postings: DataFrame,
    stats: DataFrame,
    requests: DataFrame,
    analyzer: Analyzer,
    require_all_known: bool = False,
    max_rows: int = BROADCAST_ROWS,
    merged: bool = False,
    wanted: DataFrame | None = None,
    small: bool | None = None,
    **sizes,
) -> DataFrame:
    """Answer every request: (query_id, doc_id, score, rank).

    The query side is joined to the postings by token (see ``join_tokens``); it
    is at most as large as the distinct tokens of the requests, so one check of
    these decides whether it is broadcast.  Terms of idf 0 add nothing and are
    left out once it is known which requests count.  ``merged`` postings are a view
    that merges several batches: they are cut to the request tokens before that.
    ``wanted`` are the requests' tokens where the caller has them, ``small`` the outcome of
    their size check.
    """
    if wanted is None:
        wanted = request_tokens(requests, analyzer)
    terms = known_request_tokens(wanted, stats, require_all_known).where("idf > 0")
    if small is None:
        small = is_small(wanted, max_rows)
    if merged:
        listed = wanted.select("token").distinct()
        postings = postings.join(F.broadcast(listed) if small else listed, "token", "left_semi")
    matches = join_tokens(postings, terms, max_rows=max_rows, small=small, **sizes)
    scores = positive_scores(score_sum(matches, "query_id", "doc_id"))
    return top_per_query(scores, requests)


def top_per_query(scores: DataFrame, requests: DataFrame) -> DataFrame:
    """Rank documents per query and keep each request's own top_n.

    Requests of up to ``LIMIT_ROWS`` rows have a literal bound on the rank, so Spark
    keeps each task's best rows per query before the ranking shuffle.  For larger ones
    the documents of a query are first ranked in parts, each part keeps the request's
    top_n, and these are ranked again: no task sees all documents of a query.
    """
    sizes = requests.select("query_id", effective_top_n(F.col("top_n")).alias("top_n"))
    row = sizes.agg(
        F.max(F.when(F.col("top_n") <= LIMIT_ROWS, F.col("top_n"))).alias("bound"),
        F.count(F.when(F.col("top_n") > LIMIT_ROWS, 1)).alias("large"),
        F.count(F.lit(1)).alias("n"),
    ).head()
    best_first = (F.desc("score"), F.asc("doc_id"))
    order = Window.partitionBy("query_id").orderBy(*best_first)

    def ranked_rows(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order))

    few = ranked_rows(scores).where(F.col("rank") <= int(row["bound"] or 0))
    if not row["large"]:
        return few.join(sizes, "query_id").where("rank <= top_n").drop("top_n")
    small = sizes.where(F.col("top_n") <= LIMIT_ROWS)
    found = few.join(small, "query_id").where("rank <= top_n").drop("top_n")
    large = sizes.where(F.col("top_n") > LIMIT_ROWS)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS)).alias("part")
    parts = Window.partitionBy("query_id", "part").orderBy(*best_first)
    if row["n"] <= BROADCAST_ROWS:
        large = F.broadcast(large)
    kept = (
        scores.join(large, "query_id")
        .select("query_id", "doc_id", "score", "top_n", part)
        .withColumn("rank", F.row_number().over(parts))
        .where("rank <= top_n")
        .drop("part")
    )
    many = ranked_rows(kept).where("rank <= top_n").drop("top_n")
    return found.unionByName(many)


def format_results(results: DataFrame) -> DataFrame:
    """Response fields: docId, score and the score as text with two decimals."""
    extra = [c for c in results.columns if c not in ("doc_id", "score")]
    return results.select(
        *extra,
        F.col("doc_id").alias("docId"),
        "score",
        F.format_string("%.2f", F.col("score")).alias("score_text"),
    )


def results_json(results: DataFrame) -> DataFrame:
    """One JSON object per result row: {"docId": ..., "score": ...}."""
    shaped = F.struct(F.col("doc_id").alias("docId"), F.col("score"))
    extra = [c for c in results.columns if c not in ("doc_id", "score")]
    return results.select(*extra, F.to_json(shaped).alias("response"))
