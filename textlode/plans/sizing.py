"""Size-checked joins.

A side is broadcast only after its rows and bytes were checked against bounds; a
larger side goes through a shuffled join whose hot keys are salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 5_000_000
#: Files a task analyses: a text makes some fifty bytes of n-grams for each of its own, and a
#: task that counts them holds its own in memory.
TEXT_PARTITION_BYTES = 1024 * 1024
#: Bytes of text a task analyses where the files are not known.
TEXT_BYTES = 2 * 1024 * 1024
UNKNOWN_BYTES = 2**60


def measured(df: DataFrame, *more: Column) -> tuple:
    """Rows of ``df`` and about how many bytes they hold, counted where they are made.

    Every task sends one row of partial sums; the texts of a row count with their
    bytes, any other value as eight.  ``more`` are further aggregates to return.
    """
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        size = size + 8
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), *more).head()
    return row["n"], row["bytes"] or 0, *row[2:]


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether ``df`` may be broadcast: it has few rows and few bytes."""
    rows, size = measured(df)
    return rows <= max_rows and size <= max_bytes


def join_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large table with a lookup table: broadcast when checked small.

    Beyond the bound Spark shuffles both sides; adaptive execution splits the
    partitions of hot keys on the fact side.
    """
    if is_small(lookup, max_rows):
        lookup = F.broadcast(lookup)
    return facts.join(lookup, list(on), how)


def keep_listed(
    rows: DataFrame, listed: DataFrame, column: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows whose ``column`` occurs in ``listed``, for any size of the list.

    Over an aggregate grouped by ``column`` Spark moves a broadcast list to the scan;
    a larger one is shuffled.
    """
    return join_lookup(rows, listed.select(column).distinct(), [column], "left_semi", max_rows)


def join_tokens(
    postings: DataFrame,
    lookup: DataFrame,
    spread: str = "doc_id",
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Inner join of postings with ``lookup`` (token, df, ...) on token.

    A small lookup is broadcast.  Otherwise both sides are shuffled on (token, salt).
    A token makes df x (its lookup rows) rows; it gets a salt for every ``hot_rows`` of
    them, so no task makes more of one token, however common it is and however many
    requests hold it.  A posting's salt comes from its document, lookup rows are
    repeated for each salt.  ``small`` states the outcome of the size check where the
    caller knows it.
    """
    if is_small(lookup, max_rows) if small is None else small:
        return postings.join(F.broadcast(lookup), "token")
    load = (F.max("df") * F.count(F.lit(1))).alias("_load")
    hot = (
        lookup.groupBy("token").agg(load)
        .where(F.col("_load") > hot_rows)
        .select("token", F.ceil(F.col("_load") / hot_rows).alias("_salts"))
    )
    if is_small(hot, max(max_rows, 1_000)):
        hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    marked = postings.join(hot, "token", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), salts)
    )
    repeated = lookup.join(hot, "token", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    )
    joined = marked.drop("_salts").join(repeated.drop("_salts"), ["token", "_salt"])
    return joined.drop("_salt")


def spread_by(df: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Hash-distribute texts by ``key`` over ``width``, by default :func:`spread_width`, tasks."""
    return df.repartition(width or spread_width(df), key)


def spread_width(df: DataFrame, task_bytes: int | None = None) -> int:
    """Tasks for the analysis of texts.

    The width is the largest of the configured shuffle width, two tasks per
    core and one task per ``task_bytes`` of input files (by default
    ``TEXT_PARTITION_BYTES``).  It is fixed
    on purpose: adaptive coalescing sizes partitions by the text read, but the
    analysis that follows multiplies it about tenfold.
    """
    spark = df.sparkSession
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        2 * spark.sparkContext.defaultParallelism,
        -(-input_bytes(df) // (task_bytes or TEXT_PARTITION_BYTES)),
    )


def text_width(docs: DataFrame) -> int:
    """:func:`spread_width`, but at least a task for ``TEXT_BYTES`` of ``text`` where a source
    does not tell its size, as in a micro-batch: there the bytes are counted."""
    width = spread_width(docs)
    if input_bytes(docs):
        return width
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).head()["bytes"] or 0
    return max(width, -(-size // TEXT_BYTES))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below ``df``; sources of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        size = int(str(leaves.next().stats().sizeInBytes()))
        total += size if size < UNKNOWN_BYTES else 0
    return total
