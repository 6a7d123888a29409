"""Corpus pipeline: known language, quality, one of each near-duplicate group, mixture, tokens.

``run`` applies :data:`STAGES` to ``documents``; each stage takes (spark, docs, sf_dir)
and works on all rows the stage before it kept.  All but the last return the columns
of ``docs``.  :data:`ORACLE_SQL` is None: the trained models have no SQL form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlode.llm import bpe, langid, mixing, quality, simhash
from textlode.llm.components import stored
from textlode.llm.queries import TOKENIZER, language_model, quality_machine
from textlode.sources.tables import read_table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language."""
    return langid.keep_identified(docs, language_model(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the classifier's threshold."""
    machine = quality_machine(docs, read_table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, machine)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that with the smallest identifier."""
    return simhash.keep_first(docs, shingle=4, max_bits=4, repeats=False)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources wants, in a random order."""
    return mixing.replicate(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids) of every document of the mixture."""
    rows = bpe.encode(docs.select("doc_id", "source", "lang", "text"), TOKENIZER)
    return rows.selectExpr("doc_id", "source", "lang", "cast(size(ids) as long) AS n_tokens", "ids")


STAGES = [
    ("language ID", identified),
    ("quality classifier", good),
    ("SimHash near-dedup", deduplicated),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
