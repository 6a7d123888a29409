"""Postings and term statistics.

postings     (doc_id, token, tf)         one row per document and token
token_stats  (token, df, n_docs, idf)    one row per token
docs         (doc_id, has_tokens)        one row per document
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.functions.grams import counted_grams
from textlode.functions.text import gram_rows
from textlode.operators.analysis import Analyzer
from textlode.plans.sizing import join_tokens, keep_listed, spread_by

MODES = ("float", "pruned")


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return mode


def document_table(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(doc_id, has_tokens); a narrow pass over the texts.

    With a table of stopwords the words are compared as rows and the documents
    that keep one are joined back.
    """
    docs = docs.where(F.col("text").isNotNull())
    if not isinstance(analyzer.stopwords, DataFrame):
        return docs.select("doc_id", analyzer.has_tokens(F.col("text")).alias("has_tokens"))
    kept = analyzer.kept_words(docs, "doc_id").select("doc_id").distinct()
    marked = docs.select("doc_id").join(kept.withColumn("_kept", F.lit(True)), "doc_id", "left")
    return marked.select("doc_id", F.coalesce("_kept", F.lit(False)).alias("has_tokens"))


def term_frequency(
    docs: DataFrame,
    analyzer: Analyzer,
    only_tokens: Column | None = None,
    by_document: bool = True,
    words_first: bool = False,
    numbered: bool = False,
    width: int | None = None,
) -> DataFrame:
    """Postings (doc_id, token, tf) of documents (doc_id, text).

    With ``by_document`` the *texts* are hash-distributed by document first.
    A text is several times smaller than its postings, and both the partial and
    the final count then run without a shuffle of their own.  It expects one
    row per document; where one key may hold many rows pass ``False``: the
    counts are then combined map-side and shuffled by (doc_id, token), which
    spreads a hot document over its tokens.  Both give the same rows.

    ``only_tokens`` is a predicate on ``token``, applied before counting.

    With ``words_first`` the words of a document are counted before their n-grams are
    made, so each different word is cut once; where texts are distributed by document
    that is one more aggregation and no shuffle.  It pays where documents repeat words.

    With ``numbered`` tasks count numbers of n-grams with numpy, where texts are distributed
    by document and the analysis is the default one.  Spark does not know that the rows of a
    document then lie together, so it is for readers that deal them by token.

    ``width`` is the number of tasks that texts are distributed to, by default by their size.
    """
    source = docs.select("doc_id", "text")
    if numbered and by_document and only_tokens is None and analyzer.plain:
        # Texts are put in order, so that rows of one document follow each other.
        source = spread_by(source.where(F.col("text").isNotNull()), "doc_id", width)
        source = source.sortWithinPartitions("doc_id")
        words = source.select("doc_id", analyzer.word_array(F.col("text")).alias("words"))
        return counted_grams(words, analyzer.gram_sizes)
    if by_document:
        source = spread_by(source, "doc_id", width)
    if by_document and words_first:
        words = analyzer.words(source, "doc_id").groupBy("doc_id", "word")
        tokens = gram_rows(
            words.agg(F.count(F.lit(1)).alias("n")), "word", "token", analyzer.gram_sizes
        )
        if only_tokens is not None:
            tokens = tokens.where(only_tokens)
        return tokens.groupBy("doc_id", "token").agg(F.sum("n").alias("tf"))
    tokens = analyzer.tokens(source, "doc_id")
    if only_tokens is not None:
        tokens = tokens.where(only_tokens)
    return tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """(token, df).

    (doc_id, token) is unique, so rows count documents.  The count looks at
    ``tf`` so that this branch reads the same columns as scoring does and Spark
    can reuse the shuffle below both.
    """
    return postings.groupBy("token").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df"))


def total_documents(docs: DataFrame, mode: str = "float") -> DataFrame:
    """One row (n_docs): all documents, or in ``pruned`` mode those with tokens."""
    if check_mode(mode) == "pruned":
        docs = docs.where("has_tokens")
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def idf_float(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs / df)


def idf_integer(n_docs: Column, df: Column) -> Column:
    """Logarithm of the integer quotient; 0 for tokens of over half the documents."""
    return F.log(F.call_function("div", n_docs, df))


def token_stats(
    df_table: DataFrame,
    docs: DataFrame | None,
    mode: str = "float",
    prune: bool = True,
    n_docs: int | None = None,
) -> DataFrame:
    """(token, df, n_docs, idf); N is a stored number or a scalar subquery, not a join.

    In ``pruned`` mode tokens of idf 0 are left out unless ``prune`` is off.
    """
    if n_docs is None:
        n_docs = total_documents(docs, mode).scalar()
    else:
        check_mode(mode)
        n_docs = F.lit(n_docs).cast("long")
    stats = df_table.withColumn("n_docs", n_docs)
    idf = idf_float if mode == "float" else idf_integer
    stats = stats.withColumn("idf", idf(F.col("n_docs"), F.col("df")))
    return prune_zero_idf(stats) if mode == "pruned" and prune else stats


def prune_zero_idf(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("idf") != 0)


def attach_stats(postings: DataFrame, stats: DataFrame, **sizes) -> DataFrame:
    """Copy df, N and idf onto every posting whose token has statistics."""
    return join_tokens(postings, stats, **sizes)


def lookup_tf(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """tf of each (doc_id, token) pair, 0 where there is no posting.

    Postings of other tokens are dropped at their source where the list of
    looked-up tokens is small.
    """
    postings = keep_listed(postings, pairs.select("token").distinct(), "token")
    found = pairs.join(postings, ["doc_id", "token"], "left")
    return found.withColumn("tf", F.coalesce("tf", F.lit(0).cast("long")))
