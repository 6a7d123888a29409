"""

``entry`` runs the flagship search, ``queries`` lists one query per operator and
``oracle_sql`` the equivalent DuckDB SQL over the same tables.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_queries as sql  # noqa: E402
from textlode import Analyzer, TermIndex  # noqa: E402
from textlode.functions import bytemode, markup  # noqa: E402
from textlode.functions import text as tx  # noqa: E402
from textlode.functions.porter2 import porter2_stems  # noqa: E402
from textlode.operators import ranking as rk  # noqa: E402
from textlode.operators import statistics as st  # noqa: E402
from textlode.operators import upserts as up  # noqa: E402
from textlode.plans.sizing import keep_listed  # noqa: E402
from textlode.plans.storage import new_folder, stored  # noqa: E402
from textlode.sources.documents import (  # noqa: E402
    extract_documents,
    read_documents,
    split_read_errors,
)
from textlode.sources.index_tables import IndexTables, write_index  # noqa: E402
from textlode.sources.tables import read_table, spread_scan  # noqa: E402
from textlode.sources.tf_maps import export_tf_maps, import_documents, import_tf_maps  # noqa: E402

KNOWN_SEARCH = "the thanedble and thintion of then"
UNKNOWN_SEARCH = "thanedble zzzqxv"


def entry(spark: SparkSession) -> DataFrame:
    """Ten best documents of sf0.001 for a search text."""
    return query_top_n(spark, "/root/testdata/sf0.001")


# -- inputs ----------------------------------------------------------------
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), spread over the cores when the scan has few splits."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread_scan(docs)


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html), spread like the documents."""
    return spread_scan(read_table(spark, sf_dir, "pages").select("page_id", "html"))


def doc_postings(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return st.term_frequency(docs, Analyzer(), numbered=numbered)


def doc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the plain scan: counting them moves no text."""
    return st.document_table(read_table(spark, sf_dir, "documents"), Analyzer())


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def requests_from_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a request; some sizes are 0 or missing."""
    items = read_table(spark, sf_dir, "benchmark")
    size = (F.char_length("text") % 12).cast("int")
    return items.select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("search"),
        F.when(size != 1, size).alias("top_n"),
    )


BENCHMARK_REQUESTS = """SELECT item_id AS query_id, text AS search,
  CASE WHEN length(text) % 12 <> 1 THEN length(text) % 12 END AS top_n FROM benchmark"""


# -- text ------------------------------------------------------------------
def tokenize_counts(spark, sf_dir):
    tokens = documents(spark, sf_dir).select(F.explode(tx.tokenize(F.col("text"))).alias("token"))
    return counted(tokens, "token")


def normalize_case_counts(spark, sf_dir):
    tokens = documents(spark, sf_dir).select(F.explode(tx.tokenize(F.col("text"))).alias("t"))
    return counted(tokens.select(tx.normalize_case(F.col("t")).alias("token")), "token")


def stopword_filter_counts(spark, sf_dir):
    words = Analyzer().kept_words(documents(spark, sf_dir), "doc_id")
    return counted(words.withColumnRenamed("word", "token"), "token")


def stopword_table_counts(spark, sf_dir):
    """The same filter with the list as a table: here, all language codes seen."""
    docs = read_table(spark, sf_dir, "documents")
    listed = docs.select(F.upper("lang").alias("word")).distinct()
    words = Analyzer(stopwords=listed).kept_words(docs, "doc_id")
    return counted(words.withColumnRenamed("word", "token"), "token")


def stem_reference_tokens(spark, sf_dir):
    words = Analyzer().words(documents(spark, sf_dir), "doc_id")
    return counted(words.withColumnRenamed("word", "token"), "token")


def ngram_counts(spark, sf_dir):
    words = Analyzer().words(documents(spark, sf_dir), "doc_id")
    sizes = F.array(
        *(
            F.struct(F.lit(n).alias("size"), tx.ngrams(F.col("word"), n).alias("grams"))
            for n in tx.GRAM_SIZES
        )
    )
    distinct = counted(words, "word").withColumnRenamed("n", "times")
    rows = distinct.select("times", F.inline(sizes)).select("times", "size", F.explode("grams").alias("token"))
    return rows.groupBy("size", "token").agg(F.sum("times").alias("n"))


def analyze_counts(spark, sf_dir):
    return Analyzer().counted_tokens(documents(spark, sf_dir))


def analyze_arrays(spark, sf_dir):
    tokens = Analyzer().analyze(F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", tokens.alias("tokens"))
    return rows.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"),
        F.array_max("tokens").alias("last_token"),
    )


def stem_vocabulary(spark, sf_dir):
    words = Analyzer().kept_words(documents(spark, sf_dir), "doc_id")
    vocabulary = words.select(F.lower("word").alias("word")).distinct()
    return porter2_stems(vocabulary)


def stem_vocabulary_counts(spark, sf_dir):
    analyzer = Analyzer(vocabulary_stemmer=porter2_stems)
    return analyzer.counted_tokens(documents(spark, sf_dir))


def byte_mode_counts(spark, sf_dir):
    return Analyzer(mode="bytes").counted_tokens(documents(spark, sf_dir))


def custom_tokenizer_counts(spark, sf_dir):
    """An own tokenizer: fields between blanks and line ends."""
    fields = Analyzer(
        tokenizer=lambda text: F.regexp_extract_all(text, F.lit(r"[^ \n]+"), F.lit(0)),
        gram_sizes=(),
    )
    return counted(fields.tokens(documents(spark, sf_dir), "doc_id"), "token")


def custom_stemmer_counts(spark, sf_dir):
    """An own stemmer: the first four characters."""
    prefixes = Analyzer(stemmer=lambda token: F.substring(token, 1, 4))
    return prefixes.counted_tokens(documents(spark, sf_dir))


# -- statistics ------------------------------------------------------------
def term_frequency_by_document(spark, sf_dir):
    postings = doc_postings(spark, sf_dir)
    return postings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_postings"),
        F.sum("tf").alias("n_tokens"),
        F.max("tf").alias("max_tf"),
        F.sum(F.col("tf") * F.char_length("token")).alias("n_chars"),
    )


def term_frequency_top(spark, sf_dir):
    postings = doc_postings(spark, sf_dir)
    return postings.orderBy(F.desc("tf"), "doc_id", "token").limit(1000)


def document_frequency(spark, sf_dir):
    return st.document_frequency(doc_postings(spark, sf_dir, numbered=True))


def total_documents(spark, sf_dir):
    docs = doc_table(spark, sf_dir)
    both = [
        st.total_documents(docs, mode).withColumn("mode", F.lit(mode)) for mode in st.MODES
    ]
    return both[0].unionByName(both[1])


def _stats(spark, sf_dir, mode, prune=True):
    frequencies = document_frequency(spark, sf_dir)
    stats = st.token_stats(frequencies, doc_table(spark, sf_dir), mode, prune)
    return stats.withColumn("idf", F.round("idf", 9))


def idf_float(spark, sf_dir):
    return _stats(spark, sf_dir, "float")


def idf_integer(spark, sf_dir):
    return _stats(spark, sf_dir, "pruned", prune=False)


def pruned_stats(spark, sf_dir):
    return _stats(spark, sf_dir, "pruned")


def pruned_tokens(spark, sf_dir):
    return _stats(spark, sf_dir, "pruned", prune=False).where("idf = 0").select("token", "df")


def attach_stats(spark, sf_dir):
    """Statistics copied onto the postings of index tables."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tables = write_index(spark, docs, new_folder(spark, "index"), Analyzer())
    stats = st.token_stats(tables.frequencies(), tables.documents(), "pruned")
    rows = st.attach_stats(tables.postings(), stats)
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_postings"),
        F.sum("df").alias("sum_df"),
        F.max("n_docs").alias("n_docs"),
        F.round(F.sum(F.col("tf") * F.col("idf")), 4).alias("weight"),
    )


def lookup_tf(spark, sf_dir):
    """tf of each document's language and source codes and two symbols."""
    docs = read_table(spark, sf_dir, "documents")
    probes = F.array(F.upper("lang"), F.upper("source"), F.lit("."), F.lit(","))
    pairs = docs.select("doc_id", F.explode(F.array_distinct(probes)).alias("token"))
    return st.lookup_tf(pairs, doc_postings(spark, sf_dir))


# -- queries ---------------------------------------------------------------
def scored(spark, sf_dir, search: str, mode: str) -> DataFrame:
    """Scores of one search over the texts, without building the whole index.

    Only the query's tokens are counted; the filter runs inside the scan stage.
    """
    analyzer = Analyzer()
    docs = documents(spark, sf_dir)
    tokens = rk.query_tokens(spark, search, analyzer)
    postings = st.term_frequency(docs, analyzer, rk.in_tokens(tokens), by_document=False)
    # Both df and the scores come from these few rows, so the texts are analysed once.
    postings = stored(postings, "postings")
    stats = st.token_stats(st.document_frequency(postings), doc_table(spark, sf_dir), mode)
    return rk.query(postings, stats, tokens, require_all_known=mode == "float")


def query_float(spark, sf_dir):
    return scored(spark, sf_dir, KNOWN_SEARCH, "float")


def query_pruned(spark, sf_dir):
    return scored(spark, sf_dir, KNOWN_SEARCH, "pruned")


def query_top_n(spark, sf_dir):
    return rk.query_top_n(scored(spark, sf_dir, KNOWN_SEARCH, "float"), 10)


def unknown_term_float(spark, sf_dir):
    return scored(spark, sf_dir, UNKNOWN_SEARCH, "float")


def unknown_term_pruned(spark, sf_dir):
    return scored(spark, sf_dir, UNKNOWN_SEARCH, "pruned")


def distinct_query_tokens(spark, sf_dir):
    requests = requests_from_benchmark(spark, sf_dir)
    return counted(rk.request_tokens(requests, Analyzer()), "query_id")


def match_query_tokens(spark, sf_dir):
    """Matching postings per token of one search."""
    analyzer = Analyzer()
    index = TermIndex.from_documents(documents(spark, sf_dir))
    tokens = rk.query_tokens(spark, KNOWN_SEARCH, analyzer)
    matches = rk.match_query_tokens(index.postings, index.stats, tokens)
    return matches.groupBy("token").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("sum_tf")
    )


def _batch(spark, sf_dir, requests: DataFrame, docs: DataFrame, mode: str) -> DataFrame:
    """A table of requests over texts; only tokens of some request are counted.

    Requests and texts are analysed once: their tokens and postings are stored.
    """
    analyzer = Analyzer()
    wanted = stored(rk.request_tokens(requests, analyzer), "wanted")
    postings = keep_listed(st.term_frequency(docs, analyzer, numbered=True), wanted, "token")
    postings = stored(postings, "postings")
    stats = st.token_stats(
        st.document_frequency(postings), st.document_table(docs, analyzer), mode
    )
    found = rk.search_batch(
        postings, stats, requests, analyzer, mode == "float", wanted=wanted
    )
    return found.withColumn("rank", F.col("rank").cast("long"))


def search_batch_float(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _batch(spark, sf_dir, requests_from_benchmark(spark, sf_dir), docs, "float")


def search_batch_pruned(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _batch(spark, sf_dir, requests_from_benchmark(spark, sf_dir), docs, "pruned")


def search_batch_large_top_n(spark, sf_dir):
    """Requests of up to 5,000 rows, of none stated and of a negative number."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    item = F.col("query_id")
    size = F.when(item % 20 == 0, 5000).when(item % 20 == 1, -1).otherwise(item % 4)
    requests = requests_from_benchmark(spark, sf_dir).withColumn("top_n", size.cast("int"))
    return _batch(spark, sf_dir, requests, docs, "pruned")


def search_conversations(spark, sf_dir):
    """User turns as requests, assistant turns as documents."""
    turns = read_table(spark, sf_dir, "conversations").withColumn(
        "id", F.col("conv_id") * 1000 + F.col("turn")
    )
    requests = turns.where("role = 'user'").select(
        F.col("id").alias("query_id"), F.col("text").alias("search"), F.lit(3).alias("top_n")
    )
    docs = turns.where("role = 'assistant'").select(F.col("id").alias("doc_id"), "text")
    return _batch(spark, sf_dir, requests, docs, "pruned")


def format_results(spark, sf_dir):
    return rk.format_results(query_top_n(spark, sf_dir))


def results_json(spark, sf_dir):
    top = query_top_n(spark, sf_dir).withColumn("score", F.col("score").cast("decimal(18,6)"))
    return rk.results_json(top)


# -- upserts ---------------------------------------------------------------
def turn_batches(spark, sf_dir) -> DataFrame:
    """Conversation turns as updates of one document per conversation."""
    turns = read_table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text")


def upsert_latest(spark, sf_dir):
    """Each later turn overwrites tokens and keeps the stale ones."""
    postings = up.batch_postings(turn_batches(spark, sf_dir), Analyzer())
    return postings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_postings"),
        F.sum("tf").alias("sum_tf"),
        F.sum(F.col("tf") * F.char_length("token")).alias("weight"),
    )


def upsert_replace(spark, sf_dir):
    """The last turn replaces its document."""
    turns = turn_batches(spark, sf_dir)
    postings = up.batch_postings(turns, Analyzer(), replace=True)
    return postings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("sum_tf")
    )


def bulk_update(spark, sf_dir):
    """Documents indexed, then all pages' texts upserted under the same keys."""
    index = TermIndex.from_documents(documents(spark, sf_dir))
    pages = pages_table(spark, sf_dir)
    text = markup.chardata_text(F.col("html"))
    updated = index.bulk_update(pages.select(F.col("page_id").alias("doc_id"), text.alias("text")))
    return updated.postings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("sum_tf")
    )


def update_stream(spark, sf_dir):
    """Conversation turns fed as a stream of files, one index batch per file set."""
    feed, path = new_folder(spark, "feed"), new_folder(spark, "index")
    turn_batches(spark, sf_dir).write.parquet(feed)
    stream = spark.readStream.schema("doc_id LONG, seq LONG, text STRING").parquet(feed)
    tables = IndexTables(spark, path)
    from textlode.streaming.feed import update_stream as consume

    consume(stream, tables, new_folder(spark, "checkpoint"), Analyzer())
    return tables.frequencies()


# -- tables and files ------------------------------------------------------
def index_tables(spark, sf_dir):
    """Write the index, read it back and join both tables."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_sums(write_index(spark, docs, new_folder(spark, "index"), Analyzer()))


def index_search(spark, sf_dir):
    """A query against index tables that were written and opened again."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tables = write_index(spark, docs, new_folder(spark, "index"), Analyzer())
    return TermIndex.open(spark, tables.path, "pruned").search(KNOWN_SEARCH, 25)


def index_search_blocks(spark, sf_dir):
    """Requests answered block by block from a folder of two batches."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_folder(spark, "index")
    side = F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0))
    for half in (0, 1):
        write_index(spark, docs.where(side == half), path, Analyzer(), blocks=True)
    found = TermIndex.open(spark, path, "float").search_blocks(requests_from_benchmark(spark, sf_dir))
    return found.results.withColumn("rank", F.col("rank").cast("long"))


def index_rebuild(spark, sf_dir):
    """An index built in two calls over one folder holds both halves."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_folder(spark, "index")
    side = F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0))
    for half in (0, 1):
        tables = write_index(spark, docs.where(side == half), path, Analyzer())
    return token_sums(tables).select(
        "*",
        F.lit(tables.n_docs("float")).cast("long").alias("n_docs"),
        F.lit(tables.n_docs("pruned")).cast("long").alias("n_with_tokens"),
    )


def token_sums(tables: IndexTables) -> DataFrame:
    per_token = tables.postings().groupBy("token").agg(F.sum("tf").alias("sum_tf"))
    return per_token.join(tables.frequencies(), "token")


def index_upsert(spark, sf_dir):
    """A folder opened, all pages' texts upserted under the same keys, then searched."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tables = write_index(spark, docs, new_folder(spark, "index"), Analyzer())
    pages = read_table(spark, sf_dir, "pages")
    text = markup.chardata_text(F.col("html")).alias("text")
    index = TermIndex.open(spark, tables.path, "pruned")
    return index.bulk_update(pages.select(F.col("page_id").alias("doc_id"), text)).search(
        KNOWN_SEARCH, 25
    )


def update_one(spark, sf_dir):
    """The first document of a folder updated by another text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tables = write_index(spark, docs, new_folder(spark, "index"), Analyzer())
    first = docs.agg(F.min("doc_id")).head()[0]
    updated = TermIndex.open(spark, tables.path).update(first, KNOWN_SEARCH).tables
    return token_sums(updated).withColumn("n_docs", F.lit(updated.n_docs()).cast("long"))


def update_stream_batches(spark, sf_dir):
    """Turns as a stream of files, a batch for each, that repeat documents in any order."""
    from textlode.streaming.feed import update_stream as consume

    feed = new_folder(spark, "feed")
    turn_batches(spark, sf_dir).repartition(4, "seq").write.parquet(feed)
    stream = (
        spark.readStream.schema("doc_id LONG, seq LONG, text STRING")
        .option("maxFilesPerTrigger", 1)
        .parquet(feed)
    )
    tables = IndexTables(spark, new_folder(spark, "index"))
    consume(stream, tables, new_folder(spark, "checkpoint"), Analyzer())
    return token_sums(tables)


def replace_across_batches(spark, sf_dir):
    """Turns sent in two batches that replace their documents; the last turn is left."""
    turns = turn_batches(spark, sf_dir)
    tables = IndexTables(spark, new_folder(spark, "index"))
    for half in (1, 0):
        part = turns.where(F.col("seq") % 2 == half)
        tables.write_batch(part, tables.next_batch(), Analyzer(), replace=True)
    total = tables.frequencies().agg(F.sum("df")).head()[0]
    return tables.postings().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_postings"),
        F.sum("tf").alias("sum_tf"),
        F.lit(tables.n_docs("pruned")).cast("long").alias("n_with_tokens"),
        F.lit(total).cast("long").alias("sum_df"),
    )


def stopword_table_search(spark, sf_dir):
    """An index folder whose stopwords are a table, searched."""
    docs = read_table(spark, sf_dir, "documents")
    analyzer = Analyzer(stopwords=docs.select(F.upper("lang").alias("word")).distinct())
    tables = write_index(spark, docs, new_folder(spark, "index"), analyzer)
    return TermIndex.open(spark, tables.path, "pruned", analyzer).search(KNOWN_SEARCH, 25)


def stem_vocabulary_search(spark, sf_dir):
    """An index folder of vocabulary stems, searched."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    analyzer = Analyzer(vocabulary_stemmer=porter2_stems)
    tables = write_index(spark, docs, new_folder(spark, "index"), analyzer)
    return TermIndex.open(spark, tables.path, "pruned", analyzer).search(KNOWN_SEARCH, 25)


def compact_index(spark, sf_dir):
    """Two batches with text keys, compacted to another folder."""
    docs = read_table(spark, sf_dir, "documents")
    keyed = docs.select(F.concat_ws("/", "source", "doc_id").alias("doc_id"), "text", "lang")
    path = new_folder(spark, "index")
    in_english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for english in (True, False):
        part = keyed.where(in_english == english).select("doc_id", "text")
        tables = write_index(spark, part, path, Analyzer())
    return token_sums(tables.compact(new_folder(spark, "compact")))


def tf_map_documents(spark, sf_dir):
    """Documents of exported maps, with and without tokens, where only numbers are tokens."""
    analyzer = Analyzer(
        tokenizer=lambda text: F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)),
        gram_sizes=(),
    )
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_folder(spark, "tf_maps")
    export_tf_maps(st.term_frequency(docs, analyzer), path, docs)
    return counted(import_documents(spark, path, "LONG"), "has_tokens")


def tf_map_roundtrip(spark, sf_dir):
    """Terms and documents of one export, the documents without terms included."""
    path = new_folder(spark, "tf_maps")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    export_tf_maps(doc_postings(spark, sf_dir), path, docs)
    postings, held = import_tf_maps(spark, path, "LONG"), import_documents(spark, path, "LONG")
    n_docs = held.agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("sum_tf"))
    return sums.withColumn("n_docs", n_docs)


def read_documents_chars(spark, sf_dir):
    """Texts written as files below a folder per source, read as documents."""
    folder = new_folder(spark, "files")
    docs = read_table(spark, sf_dir, "documents")
    docs.select("source", "text").write.partitionBy("source").text(folder)
    files = read_documents(spark, folder, every_file=False)
    source = F.regexp_extract("doc_id", "/source=([^/]*)/", 1).alias("source")
    return files.groupBy(source).agg(F.sum(F.char_length("text")).alias("n_chars"))


def read_every_file(spark, sf_dir):
    """Texts written below folders that Spark's listing leaves out, read as documents.

    The empty files and check sums that a writer leaves beside them are documents too;
    these have no part in the sums.
    """
    folder = new_folder(spark, "files")
    docs = read_table(spark, sf_dir, "documents")
    docs.select(F.col("source").alias(".source"), "text").write.partitionBy(".source").text(folder)
    files = read_documents(spark, folder)
    written = files.where(F.endswith("doc_id", F.lit(".txt")))
    source = F.regexp_extract("doc_id", r"/\.source=([^/]*)/", 1).alias("source")
    return written.groupBy(source).agg(F.sum(F.char_length("text")).alias("n_chars"))


def virtual_files(spark, sf_dir) -> DataFrame:
    """(path, content): pages under four extensions, as a directory scan gives them."""
    pages = pages_table(spark, sf_dir)
    ending = F.element_at(
        F.array(*(F.lit(e) for e in ("html", "xml", "txt", "pdf"))),
        (F.col("page_id") % 4 + 1).cast("int"),
    )
    path = F.concat(F.lit("file:/site/v1.0/"), F.col("page_id"), F.lit("."), ending)
    return pages.select(path.alias("path"), F.encode("html", "UTF-8").alias("content"))


def extract_documents_chars(spark, sf_dir):
    good, _ = split_read_errors(extract_documents(virtual_files(spark, sf_dir)))
    return good.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def read_errors(spark, sf_dir):
    _, bad = split_read_errors(extract_documents(virtual_files(spark, sf_dir)))
    return bad


# -- markup ----------------------------------------------------------------
def events(spark, sf_dir, strict: bool = False) -> DataFrame:
    pages = pages_table(spark, sf_dir)
    rows = markup.markup_events(F.col("html"), strict)
    return pages.select("page_id", F.posexplode(rows).alias("seq", "e")).select(
        "page_id", "seq", "e.*"
    )


def markup_events_counts(spark, sf_dir):
    return counted(events(spark, sf_dir), "kind", "name")


def markup_links(spark, sf_dir):
    """A consumer of the events: targets of links, with how often each occurs."""
    starts = events(spark, sf_dir).where("kind = 'start' AND name = 'a'")
    target = F.regexp_extract("value", r'href="([^"]*)"', 1)
    return counted(starts.select(target.alias("target")), "target")


def chardata_text(spark, sf_dir):
    pages = pages_table(spark, sf_dir)
    return pages.select("page_id", markup.chardata_text(F.col("html")).alias("text"))


def strict_prefix_text(spark, sf_dir):
    pages = pages_table(spark, sf_dir)
    return pages.select("page_id", markup.chardata_text(F.col("html"), True).alias("text"))


def markup_text_search(spark, sf_dir):
    """Benchmark texts searched in the text of the pages."""
    pages = pages_table(spark, sf_dir)
    docs = pages.select(
        F.col("page_id").alias("doc_id"), markup.chardata_text(F.col("html")).alias("text")
    )
    return _batch(spark, sf_dir, requests_from_benchmark(spark, sf_dir), docs, "pruned")


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    tokenize_counts,
    normalize_case_counts,
    stopword_filter_counts,
    stopword_table_counts,
    stem_reference_tokens,
    ngram_counts,
    analyze_counts,
    analyze_arrays,
    stem_vocabulary,
    stem_vocabulary_counts,
    byte_mode_counts,
    custom_tokenizer_counts,
    custom_stemmer_counts,
    term_frequency_by_document,
    term_frequency_top,
    document_frequency,
    total_documents,
    idf_float,
    idf_integer,
    pruned_stats,
    pruned_tokens,
    attach_stats,
    lookup_tf,
    query_float,
    query_pruned,
    query_top_n,
    unknown_term_float,
    unknown_term_pruned,
    distinct_query_tokens,
    match_query_tokens,
    search_batch_float,
    search_batch_pruned,
    search_batch_large_top_n,
    search_conversations,
    format_results,
    results_json,
    upsert_latest,
    upsert_replace,
    bulk_update,
    update_stream,
    index_tables,
    index_search,
    index_search_blocks,
    index_rebuild,
    index_upsert,
    update_one,
    update_stream_batches,
    replace_across_batches,
    stopword_table_search,
    stem_vocabulary_search,
    compact_index,
    tf_map_documents,
    tf_map_roundtrip,
    read_documents_chars,
    read_every_file,
    extract_documents_chars,
    read_errors,
    markup_events_counts,
    markup_links,
    chardata_text,
    strict_prefix_text,
    markup_text_search,
)


def _pipeline_parts() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-data operators, where these and all they need are installed."""
    try:
        import corpus_pipeline
        from textlode.llm import queries as llm
    except ImportError:
        return {}, {}
    found = {query.__name__: query for query in llm.QUERIES} | {"pipeline": corpus_pipeline.run}
    written = llm.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        written["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, written


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES} | _pipeline_parts()[0]


def oracle_sql() -> dict[str, str]:
    own = sql.registered(KNOWN_SEARCH, UNKNOWN_SEARCH, BENCHMARK_REQUESTS)
    return own | _pipeline_parts()[1]
