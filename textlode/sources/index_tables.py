"""The index as Parquet tables.

    <path>/term_freq/batch_id=K/token_bucket=B   (doc_id, token, tf, ord, block)
    <path>/forward/batch_id=K/doc_bucket=D       (doc_id, ord, block, terms [(token, tf), ...])
    <path>/docs/batch_id=K/doc_bucket=D          (doc_id, has_tokens, ord, replaces)
    <path>/token_df/batch_id=K/token_bucket=B    (token, df)   changes of df
    <path>/token_words/batch_id=K/token_bucket=B (token, word, times)   n-grams of the words
    <path>/block_max/batch_id=K/token_bucket=B   (token, block, max_tf, n), where asked for
    <path>/commits/batch_id=K                    one row that says the batch is complete

Postings are stored twice.  ``term_freq`` has them by a bucket of their token: a lookup of
some tokens reads their buckets' folders only.  One rebalancing shuffle per batch brings the
postings of a bucket together; Spark splits buckets that are too large, as those of hot
tokens.  ``forward`` has them by a bucket of their document: an upsert finds what its
documents held before in the folders of their buckets.  Texts are analysed once, into
``forward``; ``term_freq`` is made from there.

A batch that sends no document twice stores words: ``token`` in ``term_freq`` and ``forward`` is
a stemmed word, of which a corpus has several times fewer than of its n-grams, and ``token_words``
says how often each word of the batch has a token.  Readers make the tokens: a lookup of some
goes by way of their words, the whole view expands the words of a document where they lie
together.  ``grams`` of the commit has the sizes; without them a stored token is an index token,
as in batches with ``seq`` (rows of a document overwrite each other by token).  A batch with blocks
stores words in ``forward`` only, index tokens in ``term_freq`` and no ``token_words``.

Documents belong to blocks: classes of like length, each dealt to parts by hash.  A token's
postings are sorted by block, and ``block_max`` has the highest tf of each block for tokens of
``HEAVY_DF`` documents or more, which bounds the scores of a block's documents (see
:mod:`textlode.operators.blockmax`).

A batch counts once its commit row is written, last of all; readers see the postings,
documents and changes of committed batches and nothing else.  The row also holds the
number of documents, the type of the key and the numbers of buckets, so a search
neither counts documents nor asks for them.  A :class:`Snapshot` has read the commits once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from textlode.functions.grams import counted_documents, counted_terms, word_tokens
from textlode.functions.text import gram_rows
from textlode.operators.analysis import Analyzer
from textlode.operators.statistics import document_frequency
from textlode.operators.upserts import (
    batch_documents,
    batch_postings,
    current_documents,
    current_postings,
    in_order,
)
from textlode.plans.sizing import input_bytes, join_lookup, keep_listed, spread_width
from textlode.plans.storage import stored

TABLE_SCHEMAS = {
    "term_freq": "doc_id {key}, token STRING, tf BIGINT, ord BIGINT, block INT, "
    "batch_id BIGINT, token_bucket INT",
    "forward": "doc_id {key}, ord BIGINT, block INT, terms ARRAY<STRUCT<token: STRING, tf: BIGINT>>, "
    "batch_id BIGINT, doc_bucket INT",
    "docs": "doc_id {key}, has_tokens BOOLEAN, ord BIGINT, replaces BOOLEAN, batch_id BIGINT, "
    "doc_bucket INT",
    "token_df": "token STRING, df BIGINT, batch_id BIGINT, token_bucket INT",
    "token_words": "token STRING, word STRING, times BIGINT, batch_id BIGINT, token_bucket INT",
    "block_max": "token STRING, block INT, max_tf BIGINT, n BIGINT, batch_id BIGINT, "
    "token_bucket INT",
    "commits": "n_docs BIGINT, n_with_tokens BIGINT, resets BOOLEAN, replaces BOOLEAN, "
    "resent BOOLEAN, blocks BOOLEAN, "
    "key_type STRING, buckets INT, feed STRING, feed_batch BIGINT, grams ARRAY<INT>, batch_id BIGINT",
}
#: Least and most folders that tokens, and documents, of a new index are dealt to; between
#: these there is one for every so many bytes of the input's files.
TOKEN_BUCKETS = 16
MOST_BUCKETS = 4_096
BUCKET_BYTES = 512 * 1024 * 1024
#: Documents of a batch from which on a token's highest tf are stored by block.
HEAVY_DF = 64
#: Code points of a text for each row of ``forward`` that its terms are split into.
FORWARD_CHARS = 1_000_000
#: Bytes of files of a batch's texts whose words one task counts, and of ``forward`` whose
#: n-grams one task makes: each word has several.
WORD_FILE_BYTES = 8 * 1024 * 1024
VIEW_FILE_BYTES = 4 * 1024 * 1024
#: A batch's documents are broadcast up to so many bytes of files.
BATCH_FILE_BYTES = 8 * 1024 * 1024


def token_bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def doc_bucket(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def doc_block(doc_id: Column, size: Column, buckets: int) -> Column:
    """Number of a document's block: the class of its size, two to a doubling, then a hash.

    There are at most 64 classes, so at most 64 x ``MOST_BUCKETS`` blocks.
    """
    size_class = F.least(F.floor(F.log2(size + F.lit(1)) * 2), F.lit(63))
    part = F.pmod(F.xxhash64(doc_id, F.lit(2)), F.lit(buckets))
    return (size_class * buckets + part).cast("int")


def buckets_for(docs: DataFrame) -> int:
    """Folders for a new index of documents, by the bytes of their files."""
    return int(min(MOST_BUCKETS, max(TOKEN_BUCKETS, -(-input_bytes(docs) // BUCKET_BYTES))))


def expanded(rows: DataFrame, grams: Sequence[int]) -> DataFrame:
    """Rows of each token of the words that ``token`` holds; without sizes these are tokens."""
    if not grams:
        return rows
    return gram_rows(rows.withColumnRenamed("token", "word"), "word", "token", grams)


def by_document(forward: DataFrame) -> DataFrame:
    """Rows of a document together and by ``ord``, in tasks of bounded size."""
    dealt = forward.repartition(spread_width(forward, VIEW_FILE_BYTES), "doc_id")
    return dealt.sortWithinPartitions("doc_id", "ord")


def forward_rows(
    docs: DataFrame, analyzer: Analyzer, replace: bool, buckets: int, words: bool = False
) -> DataFrame:
    """(doc_id, ord, block, terms, doc_bucket) of one batch of ``in_order`` documents.

    Where each document has one row the texts are dealt to tasks by document, a multiple of
    ``buckets`` of them, so that counting needs no further shuffle and a task's rows
    belong to one bucket.  The terms of a long text make several rows; of ``words`` they are
    words without their n-grams.
    """
    rows = docs.where(F.col("text").isNotNull())
    chars = F.char_length("text").alias("chars")
    if "seq" in docs.columns:
        lengths = rows.select("doc_id", chars).groupBy("doc_id").agg(F.max("chars").alias("chars"))
        counted = batch_postings(docs, analyzer, replace).join(lengths, "doc_id")
        keys = ["doc_id", "ord", "chars"]
    else:
        width = spread_width(docs, WORD_FILE_BYTES) if words else spread_width(docs)
        width = -(-width // buckets) * buckets
        place = F.pmod(F.xxhash64("doc_id"), F.lit(width)).cast("int")
        source = rows.select("doc_id", "ord", "text", chars, place.alias("place"))

        def deal(rows: DataFrame) -> DataFrame:
            return rows.repartitionById(width, F.col("place"))

        source = deal(source)
        keys = ["doc_id", "ord", "chars", "place"]
        if words:
            counted = analyzer.counted_words(source, *keys, deal=deal).withColumnRenamed("word", "token")
        else:
            counted = analyzer.tokens(source, *keys).groupBy(*keys, "token").agg(
                F.count(F.lit(1)).alias("tf")
            )
    parts = F.greatest(F.ceil(F.col("chars") / FORWARD_CHARS), F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64("token", F.lit(1)), parts)
    grouped = counted.groupBy(*keys, part.alias("part")).agg(
        F.collect_list(F.struct("token", F.col("tf").cast("long").alias("tf"))).alias("terms")
    )
    made = grouped.select(
        "doc_id", F.col("ord").cast("long").alias("ord"),
        doc_block(F.col("doc_id"), F.col("chars"), buckets).alias("block"), "terms",
        doc_bucket(F.col("doc_id"), buckets).alias("doc_bucket"),
    )
    aligned = "seq" not in docs.columns and (words or analyzer.vocabulary_stemmer is None)
    return made if aligned else made.hint("rebalance", "doc_bucket")


class Snapshot:
    """The committed batches of an index folder at one time."""

    def __init__(self, tables: IndexTables, commits: list[Row]):
        self.tables, self.commits = tables, commits

    def n_docs(self, mode: str = "float") -> int:
        """Number of documents, or in ``pruned`` mode of those with tokens."""
        if not self.commits:
            return 0
        return self.commits[-1]["n_with_tokens" if mode == "pruned" else "n_docs"]

    @property
    def buckets(self) -> int:
        return self.commits[-1]["buckets"]

    @property
    def flat(self) -> bool:
        """Whether no document was sent again, so that the log is the current view."""
        return not any(row["resent"] for row in self.commits[1:])

    @property
    def word_grams(self) -> tuple[int, ...]:
        """Sizes of the n-grams where every batch stores words and has these, else none."""
        kinds = self.gram_batches()
        return next(iter(kinds)) if len(kinds) == 1 else ()

    def gram_batches(self, forward: bool = False) -> dict[tuple[int, ...], list[int]]:
        """Numbers of batches by the sizes of the n-grams that are made of their words, those of
        ``term_freq`` or of ``forward``."""
        kinds: dict[tuple[int, ...], list[int]] = {}
        for row in self.commits:
            grams = () if row["blocks"] and not forward else tuple(row["grams"] or ())
            kinds.setdefault(grams, []).append(row["batch_id"])
        return kinds

    @property
    def has_blocks(self) -> bool:
        """Whether the highest tf by block are stored and bound the scores of the view."""
        return self.flat and all(row["blocks"] for row in self.commits)

    def block_maxima(self, listed: DataFrame, buckets: Sequence[int]) -> DataFrame:
        """(token, block, max_tf, n) for the listed tokens, all of them in some buckets.

        ``n`` is the number of postings.  Those of tokens too rare to be stored are
        taken from their postings.
        """
        keys = ["token", "batch_id"]
        held = self._of(self._committed("block_max"), None, buckets).join(listed, "token", "left_semi")
        rows = self._of(self._committed("term_freq"), None, buckets).join(listed, "token", "left_semi")
        rare = rows.join(held.select(*keys).distinct(), keys, "left_anti")
        counted = rare.select("token", "block", F.col("tf").alias("max_tf"), F.lit(1).alias("n"))
        every = held.select("token", "block", "max_tf", "n").unionByName(counted)
        return every.groupBy("token", "block").agg(
            F.max("max_tf").alias("max_tf"), F.sum("n").alias("n")
        )

    def block_postings(self, buckets: Sequence[int]) -> DataFrame:
        """(doc_id, token, tf, block) of a view that has blocks."""
        log = self._of(self._committed("term_freq"), None, buckets)
        return log.select("doc_id", "token", "tf", "block")

    def postings(
        self,
        replace: bool | None = None,
        tokens: Sequence[str] | None = None,
        buckets: Sequence[int] | None = None,
        listed: DataFrame | None = None,
    ) -> DataFrame:
        """Current (doc_id, token, tf), of some tokens or some token buckets only where given.

        ``replace`` True reads every batch as one that replaces its documents, False
        none; by default each batch is read as it was written.  Where words are stored,
        buckets are cut to the tokens of ``listed`` before their postings are read.
        """
        if not any(self.gram_batches()):
            log = self._of(self._committed("term_freq"), tokens, buckets)
        elif tokens is None and buckets is None:
            if self.word_grams and not self._replacing(replace)[1]:
                # One kind of words: the tasks that count a document's n-grams keep its latest.
                return self._whole_log(self.word_grams, None, latest=True).drop("ord")
            log = self._union(self._whole_log)
        else:
            log = self._union(lambda grams, ids: self._looked_up(grams, ids, tokens, buckets, listed))
        if len(self.commits) == 1:
            return log.select("doc_id", "token", "tf")
        return current_postings(log, *self._replacing(replace))

    def _union(self, make: Callable[[tuple[int, ...], list[int]], DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, (make(*kind) for kind in self.gram_batches().items()))

    def _whole_log(
        self, grams: tuple[int, ...], batches: list[int] | None, latest: bool = False
    ) -> DataFrame:
        """(doc_id, token, tf, ord) of some batches that have these n-grams.

        Of words, with ``latest``, a document has each token once, with its highest ``ord``.
        """
        if not grams:
            return self._committed("term_freq", batches).select("doc_id", "token", "tf", "ord")
        words = self._committed("forward", batches).select("doc_id", "ord", "terms")
        return counted_terms(by_document(words), grams, latest=latest)

    def _looked_up(
        self,
        grams: tuple[int, ...],
        batches: list[int],
        tokens: Sequence[str] | None,
        buckets: Sequence[int] | None,
        listed: DataFrame | None,
    ) -> DataFrame:
        """(doc_id, token, tf, ord) of some tokens, where words are stored by way of these."""
        if not grams:
            log = self._of(self._committed("term_freq", batches), tokens, buckets)
            return log.select("doc_id", "token", "tf", "ord")
        held = self._of(self._committed("token_words", batches), tokens, buckets)
        if listed is not None:
            held = join_lookup(held, listed, ["token"], "left_semi")
        rows = self._committed("term_freq", batches).select(
            "doc_id", F.col("token").alias("word"), "tf", "ord", "batch_id"
        )
        held = held.select("token", "word", "times", "batch_id")
        matches = join_lookup(rows, held, ["batch_id", "word"])
        tf = F.sum(F.col("tf") * F.col("times")).alias("tf")
        summed = matches.groupBy("doc_id", "token", "ord", "batch_id").agg(tf)
        return summed.select("doc_id", "token", "tf", "ord")

    def documents(self, replace: bool | None = None) -> DataFrame:
        return current_documents(*self._replacing(replace))

    def _replacing(self, replace: bool | None) -> tuple[DataFrame, bool]:
        docs = self._committed("docs")
        if replace is None:
            return docs, any(row["replaces"] for row in self.commits)
        return docs.withColumn("replaces", F.lit(replace)), replace

    def frequencies(
        self, tokens: Sequence[str] | None = None, buckets: Sequence[int] | None = None
    ) -> DataFrame:
        """(token, df): the sum of the committed changes."""
        changes = self._of(self._committed("token_df"), tokens, buckets)
        if len(self.commits) == 1:
            return changes.select("token", "df")
        return changes.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def _of(
        self, rows: DataFrame, tokens: Sequence[str] | None, buckets: Sequence[int] | None
    ) -> DataFrame:
        """Rows of some tokens or buckets; the buckets of literals are folded while planning."""
        if buckets is not None:
            rows = rows.where(F.col("token_bucket").isin(list(buckets)))
        if tokens is not None:
            folders = [token_bucket(F.lit(token), self.buckets) for token in tokens]
            rows = rows.where(F.col("token_bucket").isin(*folders) & F.col("token").isin(list(tokens)))
        return rows

    def _committed(self, table: str, batches: list[int] | None = None) -> DataFrame:
        """Rows of the committed batches, or some; other batches' folders are not read."""
        if not self.commits:
            raise FileNotFoundError(f"no index at {self.tables.path}")
        numbers = [row["batch_id"] for row in self.commits] if batches is None else batches
        df = self.tables._read(table, self.commits[-1]["key_type"])
        return df.where(F.col("batch_id").isin(numbers))


class IndexTables:
    """Reads and writes the tables of one index folder.

    ``key_type`` is the type of ``doc_id`` of a new index, ``buckets`` its number of folders
    (by default by the size of the first batch), ``blocks`` says whether ``block_max`` is
    written; an existing index knows its own.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key_type: str = "BIGINT",
        buckets: int | None = None,
        blocks: bool = False,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self._new_key, self._new_buckets, self._new_blocks = key_type, buckets, blocks

    # -- commits -----------------------------------------------------------
    def commits(self) -> list[Row]:
        """Commit rows in order, from the last batch that began the index anew."""
        try:
            rows = self._read("commits", key="").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        rows.sort(key=lambda row: row["batch_id"])
        start = max((i for i, row in enumerate(rows) if row["resets"]), default=0)
        return rows[start:]

    def snapshot(self) -> Snapshot:
        """What is committed now; its frames stay those of now."""
        return Snapshot(self, self.commits())

    def batches(self) -> set[int]:
        return {row["batch_id"] for row in self.commits()}

    def next_batch(self) -> int:
        """The number after the last committed one; a batch that failed is written over."""
        return max(self.batches(), default=-1) + 1

    def feed_batch(self, feed: str, number: int) -> bool:
        """Whether a batch of a feed was committed before."""
        return any(r["feed"] == feed and r["feed_batch"] == number for r in self.commits())

    def n_docs(self, mode: str = "float") -> int:
        """Number of documents, or in ``pruned`` mode of those with tokens."""
        return self.snapshot().n_docs(mode)

    @property
    def key_type(self) -> str:
        commits = self.commits()
        return commits[-1]["key_type"] if commits else self._new_key

    # -- writing -----------------------------------------------------------
    def write_batch(
        self,
        docs: DataFrame,
        batch_id: int,
        analyzer: Analyzer,
        replace: bool = False,
        resets: bool = False,
        feed: str | None = None,
        feed_batch: int | None = None,
        before: list[Row] | None = None,
        unique: bool = False,
    ) -> None:
        """Add the postings of documents (doc_id, text[, seq]) as one batch.

        A document sent again overwrites: its row of highest ``seq`` counts, over
        batches too, or without ``seq`` its last row.  With ``replace`` the tokens it
        lost go, otherwise they stay.  With ``resets`` the batch is all there is.
        The work for df and N goes with the batch: what its documents held before is read
        from the folders of their buckets, and nothing else of earlier batches.  A document
        of null text is not indexed.  ``before`` are the commits where the caller has
        them, ``unique`` says that no document occurs twice.
        """
        if resets:
            before = []
        elif before is None:
            before = self.commits()
        last = before[-1] if before else None
        key = last["key_type"] if last else docs.schema["doc_id"].dataType.simpleString()
        buckets = last["buckets"] if last else self._new_buckets or buckets_for(docs)
        docs = in_order(docs, batch_id, unique)
        blocks = last["blocks"] if last else self._new_blocks
        words = "seq" not in docs.columns and all(n > 0 for n in analyzer.gram_sizes)
        grams = self._grams = tuple(analyzer.gram_sizes) if words else ()
        # Whether a row of ``term_freq`` is a document's token and counts for df as it is.
        self._token_rows = blocks and bool(grams)
        self._write_by_document(
            forward_rows(docs, analyzer, replace, buckets, bool(grams)),
            f"forward/batch_id={batch_id}",
        )
        own = self._batch("forward", key, batch_id)
        if grams and isinstance(analyzer.stopwords, DataFrame):
            # Whether a word is left was seen when the texts were analysed.
            kept = own.select("doc_id").distinct().withColumn("_kept", F.lit(True))
            known = docs.where(F.col("text").isNotNull()).select("doc_id", "ord")
            known = known.join(kept, "doc_id", "left")
            known = known.withColumn("has_tokens", F.coalesce("_kept", F.lit(False)))
        else:
            known = batch_documents(docs, analyzer, replace)
        own_docs = known.select(
            "doc_id", "has_tokens", "ord", F.lit(replace).alias("replaces"),
            doc_bucket(F.col("doc_id"), buckets).alias("doc_bucket"),
        )
        self._write_by_document(own_docs.repartition("doc_bucket"), f"docs/batch_id={batch_id}")
        if grams and blocks:
            held = by_document(own.select("doc_id", "ord", "block", "terms"))
            postings = counted_terms(held, grams, "block")
        else:
            postings = own.select("doc_id", F.inline("terms"), "ord", "block")
        self._write_bucketed(postings, f"term_freq/batch_id={batch_id}", buckets, "block")
        if grams and not blocks:
            self._write_token_words(batch_id, key, buckets, grams)
        if blocks:
            self._write_maxima(batch_id, key, buckets)
        changes, added, with_tokens = self._changes(before, batch_id, key)
        self._write_bucketed(changes, f"token_df/batch_id={batch_id}", buckets)
        row = Row(
            n_docs=added + (last["n_docs"] if last else 0),
            n_with_tokens=with_tokens + (last["n_with_tokens"] if last else 0),
            resets=resets,
            replaces=replace,
            resent=self._resent,
            blocks=blocks,
            key_type=key,
            buckets=buckets,
            feed=feed,
            feed_batch=feed_batch,
            grams=list(grams),
        )
        self._commit(row, batch_id)

    def _commit(self, row: Row, batch_id: int) -> None:
        schema = TABLE_SCHEMAS["commits"].rpartition(",")[0]
        self._write(self.spark.createDataFrame([row], schema).coalesce(1), f"commits/batch_id={batch_id}")

    def _write_token_words(
        self, batch_id: int, key: str, buckets: int, grams: tuple[int, ...]
    ) -> None:
        """Tokens of the different words of a batch, with how often the word has each."""
        rows = self._batch("term_freq", key, batch_id).select(F.col("token").alias("word"))
        words = rows.distinct().repartition(spread_width(rows, WORD_FILE_BYTES), "word")
        self._write_bucketed(word_tokens(words, grams), f"token_words/batch_id={batch_id}", buckets)

    def _write_maxima(self, batch_id: int, key: str, buckets: int) -> None:
        """Highest tf and postings by token and block, of tokens in many documents of a batch."""
        own = self._batch("term_freq", key, batch_id)
        heavy = stored(document_frequency(own).where(F.col("df") >= HEAVY_DF).select("token"), "heavy")
        cells = keep_listed(own.select("token", "block", "tf"), heavy, "token").groupBy("token", "block")
        maxima = cells.agg(F.max("tf").alias("max_tf"), F.count(F.lit(1)).alias("n"))
        self._write_bucketed(maxima, f"block_max/batch_id={batch_id}", buckets, "block")

    def _changes(
        self, before: list[Row], batch_id: int, key: str
    ) -> tuple[DataFrame, int, int]:
        """(token, df) changes of a batch just written, and those of both numbers of documents.

        Notes whether any of its documents was here before.

        A document that was here before changes df where a token is in its view after the
        batch but was not before it, or the other way round.
        """
        mine, own = self._batch("docs", key, batch_id), self._batch("forward", key, batch_id)
        count = F.count(F.lit(1))
        grams = self._grams
        if self._token_rows:
            whole = document_frequency(self._batch("term_freq", key, batch_id))
        elif grams:
            parts = counted_documents(by_document(own.select("doc_id", "ord", "terms")), grams)
            whole = parts.groupBy("token").agg(F.sum("n").alias("df"))
        else:
            tokens = own.select(F.explode("terms.token").alias("token"))
            whole = tokens.groupBy("token").agg(count.alias("df"))
        self._resent = False
        if not before:
            n = mine.agg(count.alias("n"), F.count_if("has_tokens").alias("t")).head()
            return whole, n["n"], n["t"]
        earlier = Snapshot(self, before)
        touched = F.col("doc_bucket").isin(self._buckets_of(batch_id))
        small = input_bytes(mine) <= BATCH_FILE_BYTES
        listed = mine.select("doc_id")
        known = earlier._committed("docs").where(touched).join(
            F.broadcast(listed) if small else listed, "doc_id", "left_semi"
        )
        new = F.col("new")
        rows = known.withColumn("new", F.lit(False)).unionByName(mine.withColumn("new", F.lit(True)))
        document = Window.partitionBy("doc_id")
        begins = {
            "begin_before": F.max(F.when(~new & F.col("replaces"), F.col("ord"))).over(document),
            "begin_after": F.max(F.when(F.col("replaces"), F.col("ord"))).over(document),
        }
        shown_before = ~new & _from("begin_before")
        per_doc = stored(
            rows.withColumns(begins).groupBy("doc_id").agg(
                F.max(~new).alias("known"),
                F.max(shown_before & F.col("has_tokens")).alias("had"),
                F.max(_from("begin_after") & F.col("has_tokens")).alias("have"),
                F.max("begin_before").alias("begin_before"),
                F.max("begin_after").alias("begin_after"),
            ),
            "per_doc",
        )
        n = per_doc.agg(
            F.count_if(~F.col("known")).alias("added"),
            F.count_if("known").alias("again"),
            (F.count_if("have") - F.count_if("had")).alias("t"),
        ).head()
        self._resent = bool(n["again"])
        if not n["again"]:
            return whole, n["added"], n["t"]
        views = per_doc.select("doc_id", "begin_before", "begin_after")
        views = F.broadcast(views) if small else views
        old = earlier._committed("forward").where(touched).withColumn("new", F.lit(False))
        held = old.unionByName(own.withColumn("new", F.lit(True))).join(views, "doc_id")
        kinds = earlier.gram_batches(forward=True)
        kinds.setdefault(grams, []).append(batch_id)
        # A few rows hold many tokens each: they are dealt by size before tokens are made of them.
        held = held.repartition(spread_width(held, VIEW_FILE_BYTES), "doc_id")
        shown = held.select(
            "doc_id",
            F.explode("terms.token").alias("token"),
            shown_before.cast("int").alias("before"),
            _from("begin_after").cast("int").alias("after"),
            "batch_id",
        )
        if len(kinds) == 1:
            shown = expanded(shown, *kinds)
        else:
            shown = reduce(
                DataFrame.unionByName,
                (expanded(shown.where(F.col("batch_id").isin(ids)), sizes) for sizes, ids in kinds.items()),
            )
        signed = shown.groupBy("doc_id", "token").agg(
            (F.max("after") - F.max("before")).cast("long").alias("n")
        )
        changes = signed.where("n <> 0").groupBy("token").agg(F.sum("n").alias("df")).where("df <> 0")
        return changes, n["added"], n["t"]

    def _buckets_of(self, batch_id: int) -> list[int]:
        """Document buckets that a batch wrote to, by the names of its folders."""
        files = self.spark.read.schema("doc_id STRING").parquet(f"{self.path}/docs/batch_id={batch_id}")
        return sorted({int(n) for f in files.inputFiles() for n in re.findall(r"/doc_bucket=(\d+)/", f)})

    def refresh_stats(self) -> None:
        """Merge all changes of df into those of the last batch, to read one batch only.

        The index then has to be read from its last batch on, so this writes a new
        batch that holds the current view: see :meth:`compact` for a new folder.
        """
        now = self.snapshot()
        last = now.commits[-1]
        docs = stored(now.documents(), "documents")
        if now.flat and now.word_grams:
            self._write_words(now, docs, last["batch_id"] + 1, last)
        else:
            self._write_view(stored(now.postings(), "postings"), docs, last["batch_id"] + 1, last, resets=True)

    def compact(self, path: str) -> IndexTables:
        """Write the current view as the single batch of another index folder."""
        now = self.snapshot()
        last = now.commits[-1]
        target = IndexTables(self.spark, path, last["key_type"], last["buckets"])
        if now.flat and now.word_grams:
            target._write_words(now, now.documents(), target.next_batch(), last)
            return target
        postings = stored(now.postings(), "postings")
        target._write_view(postings, now.documents(), target.next_batch(), last, resets=True)
        return target

    def _write_words(self, now: Snapshot, docs: DataFrame, batch_id: int, last: Row) -> None:
        """The current view of words where no document was sent again: all batches' rows as they are."""
        order, buckets = F.lit(batch_id).cast("long").alias("ord"), last["buckets"]
        postings = now._committed("term_freq").select("doc_id", "token", "tf", order, "block")
        self._write_bucketed(postings, f"term_freq/batch_id={batch_id}", buckets, "block")
        self._write_by_document(
            docs.select("doc_id", "has_tokens", order, F.lit(False).alias("replaces"),
                        doc_bucket(F.col("doc_id"), buckets).alias("doc_bucket"))
            .repartition("doc_bucket"),
            f"docs/batch_id={batch_id}",
        )
        forward = now._committed("forward").select("doc_id", order, "block", "terms", "doc_bucket")
        self._write_by_document(
            forward.hint("rebalance", "doc_bucket"), f"forward/batch_id={batch_id}"
        )
        self._write_token_words(batch_id, last["key_type"], buckets, now.word_grams)
        self._write_bucketed(now.frequencies(), f"token_df/batch_id={batch_id}", buckets)
        row = last.asDict() | {
            "resets": True, "replaces": False, "resent": False, "feed": None, "feed_batch": None,
        }
        row.pop("batch_id")
        self._commit(Row(**row), batch_id)

    def _write_view(
        self, postings: DataFrame, docs: DataFrame, batch_id: int, last: Row, resets: bool
    ) -> None:
        order, buckets = F.lit(batch_id).cast("long").alias("ord"), last["buckets"]
        bucket = doc_bucket(F.col("doc_id"), buckets).alias("doc_bucket")
        # As many parts as its number of tokens asks for, to keep rows bounded.
        sizes = postings.groupBy("doc_id").agg(
            F.ceil(F.count(F.lit(1)) / FORWARD_CHARS).alias("parts"),
            doc_block(F.col("doc_id"), F.sum("tf"), buckets).alias("block"),
        )
        of_doc = sizes.select(F.col("doc_id").alias("_doc"), "block")
        sized = postings.join(of_doc, F.col("doc_id").eqNullSafe(F.col("_doc")))
        sized = sized.select("doc_id", "token", "tf", order, "block")
        self._write_bucketed(sized, f"term_freq/batch_id={batch_id}", buckets, "block")
        self._write_by_document(
            docs.select("doc_id", "has_tokens", order, F.lit(False).alias("replaces"), bucket)
            .repartition("doc_bucket"),
            f"docs/batch_id={batch_id}",
        )
        own = self._batch("term_freq", last["key_type"], batch_id)
        terms = F.collect_list(F.struct("token", "tf")).alias("terms")
        part = F.pmod(F.xxhash64("token", F.lit(1)), F.col("parts")).alias("part")
        parts = sizes.select("doc_id", "parts")
        forward = own.join(parts, "doc_id").groupBy("doc_id", "block", part).agg(terms)
        self._write_by_document(
            forward.select("doc_id", order, "block", "terms", bucket).hint("rebalance", "doc_bucket"),
            f"forward/batch_id={batch_id}",
        )
        self._write_bucketed(document_frequency(own), f"token_df/batch_id={batch_id}", buckets)
        if last["blocks"]:
            self._write_maxima(batch_id, last["key_type"], buckets)
        row = last.asDict() | {
            "resets": resets, "replaces": False, "resent": False, "feed": None, "feed_batch": None,
            "grams": [],
        }
        row.pop("batch_id")
        self._commit(Row(**row), batch_id)

    def _write_by_document(self, df: DataFrame, table: str) -> None:
        """In folders by bucket of the document, its rows together."""
        (
            df.sortWithinPartitions("doc_bucket", "doc_id")
            .write.mode("overwrite")
            .option("compression", "zstd")
            .partitionBy("doc_bucket")
            .parquet(f"{self.path}/{table}")
        )

    def _write_bucketed(self, df: DataFrame, table: str, buckets: int, *then: str) -> None:
        """Sorted by token within the folder of its bucket; large buckets are split."""
        dealt = df.withColumn("token_bucket", token_bucket(F.col("token"), buckets)).hint(
            "rebalance", "token_bucket"
        )
        (
            dealt.sortWithinPartitions("token_bucket", "token", *then)
            .write.mode("overwrite")
            .option("compression", "zstd")
            .partitionBy("token_bucket")
            .parquet(f"{self.path}/{table}")
        )

    def _write(self, df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}")

    # -- reading -----------------------------------------------------------
    def log(self) -> DataFrame:
        return self.snapshot()._committed("term_freq")

    def docs_log(self) -> DataFrame:
        return self.snapshot()._committed("docs")

    def postings(self, replace: bool | None = None, tokens: Sequence[str] | None = None) -> DataFrame:
        """See :meth:`Snapshot.postings`, of what is committed now."""
        return self.snapshot().postings(replace, tokens)

    def documents(self, replace: bool | None = None) -> DataFrame:
        return self.snapshot().documents(replace)

    def frequencies(self, tokens: Sequence[str] | None = None) -> DataFrame:
        return self.snapshot().frequencies(tokens)

    def _batch(self, table: str, key: str, batch_id: int) -> DataFrame:
        return self._read(table, key).where(F.col("batch_id") == batch_id)

    def _read(self, table: str, key: str) -> DataFrame:
        """Raises Spark's path error where the table does not exist."""
        folder = f"{self.path}/{table}"
        schema = TABLE_SCHEMAS[table].format(key=key)
        return self.spark.read.schema(schema).option("basePath", folder).parquet(folder)


def _from(begin: str) -> Column:
    """Whether a row is not before the last one that replaced its document."""
    return F.col(begin).isNull() | (F.col("ord") >= F.col(begin))


def write_index(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    analyzer: Analyzer,
    overwrite: bool = False,
    buckets: int | None = None,
    blocks: bool = False,
) -> IndexTables:
    """Index documents (doc_id, text) in a folder.

    A folder that holds an index is extended by them; with ``overwrite`` they take
    its place, in one step: readers see the old index until the new one is complete.
    """
    tables = IndexTables(spark, path, docs.schema["doc_id"].dataType.simpleString(), buckets, blocks)
    commits = tables.commits()
    batch = max((row["batch_id"] for row in commits), default=-1) + 1
    tables.write_batch(docs, batch, analyzer, resets=overwrite or not commits, before=commits)
    return tables


def read_index(spark: SparkSession, path: str) -> IndexTables:
    """Open an existing index; a missing one raises Spark's path error."""
    tables = IndexTables(spark, path)
    tables._read("commits", "")
    return tables
