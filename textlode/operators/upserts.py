"""Upserts on an append-only log of postings.

log       (doc_id, token, tf, ord)               unique per document, token, batch
docs_log  (doc_id, has_tokens, ord, replaces)    unique per document, batch

``ord`` is the ``seq`` of the row a value comes from, or the number of its batch in
an index that is fed without ``seq``.  The current index is a view of the log: for
every (doc_id, token) the tf of highest ``ord``, so it does not depend on how rows
were cut into batches.  Re-indexing a document overwrites and adds tokens but keeps
those its new text no longer has; a row that ``replaces`` its document drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.operators.analysis import Analyzer
from textlode.operators.statistics import document_table, term_frequency
from textlode.plans.sizing import input_bytes, spread_width, text_width
from textlode.plans.storage import stored

#: Files of a log of postings up to which it is merged in the tasks that read it.
LOG_FILE_BYTES = 32 * 1024 * 1024


def in_order(docs: DataFrame, batch_id: int = 0, unique: bool = False) -> DataFrame:
    """(doc_id, text, seq, ord): documents with the order their rows apply in.

    With ``seq`` both are that.  Without it all rows have the batch's number as
    ``ord``; if a document occurs more than once, ``seq`` numbers the rows as they
    are read, else it is left out.  Numbered rows are stored, so that all that is made
    of them sees one order.  ``unique`` says that no document does.
    """
    if "seq" in docs.columns:
        return docs.select("doc_id", "text", "seq", F.col("seq").cast("long").alias("ord"))
    number = F.lit(batch_id).cast("long").alias("ord")
    if unique:
        return docs.select("doc_id", "text", number)
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.head(1):
        return docs.select("doc_id", "text", number)
    order = F.monotonically_increasing_id().alias("seq")
    return stored(docs.select("doc_id", "text", order, number), "numbered")


def batch_postings(
    docs: DataFrame, analyzer: Analyzer, replace: bool = False, width: int | None = None
) -> DataFrame:
    """(doc_id, token, tf, ord) of one batch of :func:`in_order` documents.

    Rows of the same document are applied in ``seq`` order; grouping by token first
    keeps a document that was sent many times from piling up in one task.  ``width`` is the
    number of tasks for documents that have one row each.
    """
    if "ord" not in docs.columns:
        docs = in_order(docs)
    if "seq" not in docs.columns:
        order = docs.agg(F.max("ord")).scalar()
        return term_frequency(docs, analyzer, width=width).withColumn("ord", order)
    if replace:
        docs = last_in_batch(docs)
    # The rows of a document sent many times go to as many tasks, a bounded part of the texts to each.
    dealt = docs.repartition(text_width(docs), "doc_id", "seq")
    counted = (
        analyzer.tokens(dealt, "doc_id", "seq", "ord")
        .groupBy("doc_id", "token", "seq", "ord")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    return counted.groupBy("doc_id", "token").agg(
        F.max_by("tf", "seq").alias("tf"), F.max("ord").alias("ord")
    )


def last_in_batch(docs: DataFrame) -> DataFrame:
    """Each document's row of highest seq; only keys are aggregated."""
    last = docs.groupBy("doc_id").agg(F.max("seq").alias("seq"))
    return docs.join(last, ["doc_id", "seq"])


def batch_documents(docs: DataFrame, analyzer: Analyzer, replace: bool = False) -> DataFrame:
    """(doc_id, has_tokens, ord) of one batch; with ``replace`` its last row decides."""
    if "ord" not in docs.columns:
        docs = in_order(docs)
    if "seq" not in docs.columns:
        order = docs.agg(F.max("ord")).scalar()
        return document_table(docs, analyzer).withColumn("ord", order)
    if replace:
        docs = last_in_batch(docs)
    keyed = docs.select(F.struct("doc_id", "ord").alias("doc_id"), "text")
    table = document_table(keyed, analyzer).select("doc_id.*", "has_tokens")
    return table.groupBy("doc_id").agg(
        F.max("has_tokens").alias("has_tokens"), F.max("ord").alias("ord")
    )


def latest_postings(log: DataFrame, dealt: bool = False) -> DataFrame:
    """Current (doc_id, token, tf): the highest ord wins, stale tokens stay.

    Both columns of the aggregation buffer are longs, so it stays a hash
    aggregation with a map-side part.  Rows of a log beyond ``LOG_FILE_BYTES`` are dealt to
    tasks by its size first: few of them repeat, so a map-side part would only hold them all.
    ``dealt`` says that the rows of a document lie in one task of bounded size already.
    """
    if not dealt and input_bytes(log) > LOG_FILE_BYTES:
        log = log.repartition(spread_width(log), "doc_id", "token")
    return log.groupBy("doc_id", "token").agg(F.max_by("tf", "ord").alias("tf"))


def current_postings(
    log: DataFrame, docs_log: DataFrame, replaces: bool = False, dealt: bool = False
) -> DataFrame:
    """Current (doc_id, token, tf) of logs; ``replaces`` says whether any row does.

    What lies before the last replacing row of a document is gone.  For ``dealt`` see
    :func:`latest_postings`.
    """
    if not replaces:
        return latest_postings(log, dealt)
    begins = docs_log.where("replaces").groupBy("doc_id").agg(F.max("ord").alias("_from"))
    kept = log.join(begins, "doc_id", "left").where("_from IS NULL OR ord >= _from")
    return latest_postings(kept)


def current_documents(docs_log: DataFrame, replaces: bool = False) -> DataFrame:
    """Current (doc_id, has_tokens); unless replaced, a token once seen stays."""
    kept = docs_log
    if replaces:
        begins = docs_log.where("replaces").groupBy("doc_id").agg(F.max("ord").alias("_from"))
        kept = docs_log.join(begins, "doc_id", "left").where("_from IS NULL OR ord >= _from")
    return kept.groupBy("doc_id").agg(F.max("has_tokens").alias("has_tokens"))
