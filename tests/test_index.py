import re

import pytest
from conftest import plan_of
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textlode import Analyzer, TermIndex
from textlode.operators import upserts as up
from textlode.operators.statistics import document_frequency, term_frequency
from textlode.plans import sizing
from textlode.sources.documents import (
    classify_format,
    extract_documents,
    read_documents,
    split_read_errors,
)
from textlode.sources.index_tables import IndexTables, read_index, write_index
from textlode.sources.tables import spread_scan
from textlode.sources.tf_maps import export_tf_maps, import_documents, import_tf_maps
from textlode.streaming.feed import update_stream

AN = Analyzer(gram_sizes=())


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def postings_of(df):
    return rows(df, "doc_id", "token", "tf")


def test_update_overwrites_adds_and_keeps(corpus):
    index = TermIndex.from_documents(corpus(["xx zz zz zz zz zz"]), analyzer=AN)
    index = index.update(0, "xx " * 6 + "xx").update(1, "xx")
    assert postings_of(index.postings) == [(0, "XX", 7), (0, "ZZ", 5), (1, "XX", 1)]
    assert index.docs.count() == 2


def test_batch_applies_rows_in_order(spark):
    sent = [(0, 1, "xx zz"), (0, 2, "xx xx"), (0, 0, "xx xx xx qq"), (1, 0, "the")]
    docs = spark.createDataFrame(sent, "doc_id long, seq long, text string")
    assert postings_of(up.batch_postings(docs, AN)) == [(0, "QQ", 1), (0, "XX", 2), (0, "ZZ", 1)]
    assert postings_of(up.batch_postings(docs, AN, replace=True)) == [(0, "XX", 2)]
    assert rows(up.batch_documents(docs, AN), "doc_id", "has_tokens") == [(0, True), (1, False)]


def test_replacing_view(spark, corpus, tmp_path):
    tables = IndexTables(spark, str(tmp_path / "i"))
    tables.write_batch(corpus(["xx", "qq"]), 0, AN)
    tables.write_batch(corpus(["zz", "the"]), 1, AN)
    assert postings_of(tables.postings()) == [(0, "XX", 1), (0, "ZZ", 1), (1, "QQ", 1)]
    assert postings_of(tables.postings(replace=True)) == [(0, "ZZ", 1)]
    assert rows(tables.documents(replace=True), "doc_id", "has_tokens") == [(0, True), (1, False)]
    assert rows(tables.documents(), "doc_id", "has_tokens") == [(0, True), (1, True)]


def test_split_batches_equal_one_batch(spark, corpus, tmp_path):
    docs = corpus(["aa bb", "bb cc", "cc dd", "dd aa the"])
    whole = write_index(spark, docs, str(tmp_path / "whole"), AN)
    parts = write_index(spark, docs.where("doc_id < 2"), str(tmp_path / "parts"), AN)
    parts.write_batch(docs.where("doc_id >= 2"), 1, AN)
    assert postings_of(parts.postings()) == postings_of(whole.postings())
    assert rows(parts.frequencies(), "token", "df") == rows(whole.frequencies(), "token", "df")
    compacted = parts.compact(str(tmp_path / "compacted"))
    assert compacted.n_docs() == parts.n_docs() == whole.n_docs() == 4
    assert compacted.batches() == {0}
    assert postings_of(compacted.postings()) == postings_of(whole.postings())


def test_extended_stats_equal_recomputed(spark, corpus, tmp_path):
    tables = write_index(spark, corpus(["aa bb", "bb cc", "xx"]), str(tmp_path / "i"), AN)
    for batch, texts in enumerate((["bb bb zz"], ["cc", "aa", "xx yy"]), 1):
        tables.write_batch(corpus(texts), batch, AN)
        fresh = document_frequency(tables.postings())
        assert rows(tables.frequencies(), "token", "df") == rows(fresh, "token", "df")


def test_index_folder(spark, corpus, tmp_path):
    path = str(tmp_path / "i")
    texts = ["rust lang", "rust", "zig zag", "gopher"]
    write_index(spark, corpus(texts), path, Analyzer())
    index = TermIndex.open(spark, path)
    fresh = TermIndex.from_documents(corpus(texts))
    assert index.search("rust zag").collect() == fresh.search("rust zag").collect() != []
    grown = index.bulk_update(corpus(["rust", "zag rust"]))
    again = TermIndex.open(spark, path)
    assert grown.search("zag").collect() == again.search("zag").collect() != []
    with pytest.raises(AnalysisException):
        read_index(spark, str(tmp_path / "missing"))


def test_search_reads_only_the_buckets_of_its_tokens(spark, corpus, tmp_path):
    path = str(tmp_path / "i")
    write_index(spark, corpus(["rust lang", "rust", "zig zag go"]), path, AN)
    found = TermIndex.open(spark, path, analyzer=AN).search("rust")
    assert [r.doc_id for r in found.collect()] == [0, 1]
    plan = found._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("PartitionFilters" in s and "token_bucket" in s for s in scans)
    assert not any("/docs" in s or "has_tokens" in s for s in scans)
    tables = read_index(spark, path)
    one = tables.postings(tokens=["RUST"])
    files = [r[0] for r in one.select(F.input_file_name()).distinct().collect()]
    assert len(files) == 1 and len(tables.log().inputFiles()) > 1


def test_batch_search_over_merged_batches(spark, corpus, tmp_path):
    texts = ["rust lang", "rust sky", "zig zag", "gopher"]
    docs, path = corpus(texts), str(tmp_path / "i")
    tables = write_index(spark, docs.where("doc_id < 2"), path, Analyzer())
    tables.write_batch(docs.where("doc_id >= 2"), 1, Analyzer())
    asked = [(1, "rust zag", 5), (2, "sky", 1)]
    requests = spark.createDataFrame(asked, "query_id long, search string, top_n int")
    merged = TermIndex.open(spark, path).search_batch(requests)
    fresh = TermIndex.from_documents(docs).search_batch(requests)
    assert sorted(merged.collect()) == sorted(fresh.collect()) != []
    # The cut to the request tokens runs below the merge.
    lines = merged._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    merge = next(i for i, line in enumerate(lines) if "max_by" in line)
    assert merge < semi


def test_string_keys(spark, corpus, tmp_path):
    path = str(tmp_path / "i")
    write_index(spark, corpus({"007": "rust", "7": "gopher"}), path, AN)
    index = TermIndex.open(spark, path, analyzer=AN)
    assert [r.doc_id for r in index.search("rust").collect()] == ["007"]
    compacted = index.update("8", "rust").tables.compact(str(tmp_path / "c"))
    found = TermIndex.open(spark, compacted.path, analyzer=AN).search("rust")
    assert [r.doc_id for r in found.collect()] == ["007", "8"]


def test_building_again_extends_and_overwrite_replaces(spark, corpus, tmp_path):
    path = str(tmp_path / "i")
    write_index(spark, corpus({0: "aa bb", 1: "the"}), path, AN)
    write_index(spark, corpus({2: "bb cc", 0: "aa aa"}), path, AN)
    tables = read_index(spark, path)
    assert postings_of(tables.postings()) == [
        (0, "AA", 2), (0, "BB", 1), (2, "BB", 1), (2, "CC", 1)
    ]
    assert rows(tables.frequencies(), "token", "df") == [("AA", 1), ("BB", 2), ("CC", 1)]
    assert (tables.n_docs(), tables.n_docs("pruned")) == (3, 2)
    write_index(spark, corpus({7: "dd"}), path, AN, overwrite=True)
    assert postings_of(tables.postings()) == [(7, "DD", 1)]
    assert rows(tables.frequencies(), "token", "df") == [("DD", 1)]
    assert tables.n_docs() == 1 and rows(tables.documents(), "doc_id") == [(7,)]


def test_a_batch_without_commit_is_not_seen(spark, corpus, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    tables = write_index(spark, corpus(["aa"]), path, AN)
    with monkeypatch.context() as patch:
        patch.setattr(IndexTables, "_changes", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tables.write_batch(corpus(["aa aa", "zz"]), 1, AN)
    assert postings_of(tables.postings()) == [(0, "AA", 1)]
    assert tables.documents().count() == tables.n_docs() == 1
    tables.write_batch(corpus(["bb"]), tables.next_batch(), AN)
    assert postings_of(tables.postings()) == [(0, "AA", 1), (0, "BB", 1)]
    tables.refresh_stats()
    assert len(tables.batches()) == 1
    assert postings_of(tables.postings()) == [(0, "AA", 1), (0, "BB", 1)]
    assert rows(tables.frequencies(), "token", "df") == [("AA", 1), ("BB", 1)]


@pytest.mark.parametrize("replace", [False, True])
def test_last_row_of_a_document_counts(spark, corpus, tmp_path, replace):
    sent = spark.createDataFrame([(0, "xx xx yy"), (0, "xx"), (1, "zz")], "doc_id long, text string")
    tables = IndexTables(spark, str(tmp_path / "i"))
    tables.write_batch(sent.coalesce(1), 0, AN, replace)
    kept = [] if replace else [(0, "YY", 1)]
    assert postings_of(tables.postings()) == [(0, "XX", 1), *kept, (1, "ZZ", 1)]
    assert tables.n_docs() == 2


def test_replacing_updates_stats_and_documents(spark, corpus, tmp_path):
    path = str(tmp_path / "i")
    write_index(spark, corpus({0: "aa bb", 1: "aa"}), path, AN)
    index = TermIndex.open(spark, path, "pruned", AN).bulk_update(
        corpus({0: "the", 2: "aa cc"}), replace=True
    )
    assert postings_of(index.postings) == [(1, "AA", 1), (2, "AA", 1), (2, "CC", 1)]
    assert rows(index.frequencies, "token", "df") == [("AA", 2), ("CC", 1)]
    assert (index.tables.n_docs(), index.tables.n_docs("pruned")) == (3, 2)
    assert rows(index.docs, "doc_id", "has_tokens") == [(0, False), (1, True), (2, True)]
    loose = TermIndex.from_documents(corpus({0: "aa bb", 1: "aa"}), "pruned", AN)
    loose = loose.bulk_update(corpus({0: "the", 2: "aa cc"}), replace=True)
    assert postings_of(loose.postings) == postings_of(index.postings)
    assert rows(loose.docs, "doc_id", "has_tokens") == rows(index.docs, "doc_id", "has_tokens")


def test_order_of_batches_does_not_matter_with_seq(spark, tmp_path):
    sent = [(0, 1, "aa bb"), (0, 3, "aa aa aa"), (0, 2, "aa aa cc"), (1, 1, "dd"), (1, 2, "ee")]
    for replace in (False, True):
        found = []
        for i, cut in enumerate(([[0, 1, 2, 3, 4]], [[0, 3], [1], [2, 4]], [[1, 4], [2, 3], [0]])):
            tables = IndexTables(spark, str(tmp_path / f"{replace}-{i}"))
            for part in cut:
                batch = spark.createDataFrame(
                    [sent[j] for j in part], "doc_id long, seq long, text string"
                )
                tables.write_batch(batch, tables.next_batch(), AN, replace)
            found.append((postings_of(tables.postings()), rows(tables.frequencies(), "token", "df")))
        assert found[0] == found[1] == found[2]


def test_stopword_table_in_an_index(spark, corpus, tmp_path):
    stop = Analyzer(stopwords=spark.createDataFrame([("AA",)], "word string"), gram_sizes=())
    tables = write_index(spark, corpus(["aa bb", "aa", "bb cc"]), str(tmp_path / "i"), stop)
    assert rows(tables.documents(), "doc_id", "has_tokens") == [(0, True), (1, False), (2, True)]
    found = TermIndex.open(spark, tables.path, "float", stop).search("cc aa")
    assert [r.doc_id for r in found.collect()] == [2]


def stream_of(spark, folder):
    return spark.readStream.schema("doc_id LONG, text STRING").parquet(folder)


def test_stream_equals_batch_and_replay(spark, corpus, tmp_path):
    docs = corpus(["aa bb", "bb cc", "cc dd aa"])
    feed, path = str(tmp_path / "feed"), str(tmp_path / "i")
    docs.repartition(3).write.parquet(feed)
    tables = IndexTables(spark, path)
    update_stream(stream_of(spark, feed), tables, str(tmp_path / "c1"), AN)
    whole = postings_of(term_frequency(docs, AN))
    assert postings_of(tables.postings()) == whole
    # The same feed again from a fresh checkpoint overwrites with what is there.
    update_stream(stream_of(spark, feed), tables, str(tmp_path / "c2"), AN)
    assert postings_of(tables.postings()) == whole
    n = len(tables.batches())
    update_stream(stream_of(spark, feed), tables, str(tmp_path / "c2"), AN)
    assert len(tables.batches()) == n and tables.feed_batch(str(tmp_path / "c2"), 0)
    # New files continue after the last batch.
    index = TermIndex.open(spark, path, analyzer=AN)
    more = str(tmp_path / "more")
    corpus(["zz"]).write.parquet(more)
    grown = index.update_stream(stream_of(spark, more), str(tmp_path / "c3"))
    assert (0, "ZZ", 1) in postings_of(grown.postings)
    assert len(postings_of(grown.postings)) == len(whole) + 1
    with pytest.raises(ValueError):
        TermIndex.from_documents(docs).update_stream(stream_of(spark, more), "x")


def test_tf_maps(spark, corpus, tmp_path):
    postings = term_frequency(corpus(['a"b \\ c ', "bb bb"]), Analyzer())
    export_tf_maps(postings, str(tmp_path / "maps"))
    back = import_tf_maps(spark, str(tmp_path / "maps"), "LONG")
    assert postings_of(back) == postings_of(postings)
    assert any(token == "" for _, token, _ in postings_of(back))
    docs = corpus(["aa", "the", None])
    export_tf_maps(term_frequency(docs, AN), str(tmp_path / "all"), docs)
    every = import_documents(spark, str(tmp_path / "all"), "LONG")
    assert rows(every, "doc_id", "has_tokens") == [(0, True), (1, False), (2, False)]


def test_exported_lines_are_read_in_tasks_as_spark_reads_them(spark, tmp_path):
    lines = [
        '{"doc_id":1,"tf":{"A\\n\\"é":2,"B":1}}', '{"doc_id":2,"tf":{}}', "", "  ", '{"doc_id":3}', "{broken",
        '{"doc_id":null,"tf":{"C":9007199254740993}}', '{"tf":{"𐐷":1},"doc_id":5}', "[1]", "7",
    ]
    (tmp_path / "part.json").write_text("\n".join(lines) + "\n", "utf-8")
    path = str(tmp_path)
    schema = "doc_id LONG, tf MAP<STRING,BIGINT>"
    old = spark.read.schema(schema).json(path)
    terms = import_tf_maps(spark, path, "LONG")
    # Spark's reader remembers every name of an entry, which takes most of its time.
    assert "MapInArrow" in plan_of(terms) and "Scan json" not in plan_of(terms)
    order = str
    assert sorted(map(tuple, terms.collect()), key=order) == sorted(
        map(tuple, old.select("doc_id", F.explode("tf")).collect()), key=order
    )
    has = F.coalesce(F.size("tf") > 0, F.lit(False))
    assert sorted(map(tuple, import_documents(spark, path, "LONG").collect()), key=order) == sorted(
        map(tuple, old.select("doc_id", has).collect()), key=order
    )
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "part.json").write_text('{"doc_id":"a","tf":{"A":1}}\n{"doc_id":7,"tf":{"B":1}}', "utf-8")
    named = import_tf_maps(spark, f"{path}/s").collect()
    assert sorted(map(tuple, named)) == [("7", "B", 1), ("a", "A", 1)]



@pytest.mark.parametrize(
    ("path", "kind"),
    [
        ("a.html", "markup"),
        ("a.HTML", "plain"),
        ("a", "plain"),
        ("/v1.0/x", "plain"),
        ("/site.xml", "markup"),
        ("b.c.pdf", "pdf"),
        ("svg", "markup"),
    ],
)
def test_classify_format(value, path, kind):
    assert value(classify_format, path) == kind


def test_read_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "sub" / "b.html").write_text("<p>x<br>y</p>")
    (tmp_path / "sub" / "c.pdf").write_bytes(b"%PDF")
    good, bad = split_read_errors(read_documents(spark, str(tmp_path)))
    assert rows(good, "doc_id", "text") == [
        (f"{tmp_path}/a.txt", "plain � text"),
        (f"{tmp_path}/sub/b.html", "x y "),
    ]
    assert rows(bad, "doc_id", "error") == [(f"{tmp_path}/sub/c.pdf", "unsupported")]
    index = TermIndex.from_documents(good, analyzer=AN)
    assert [r.doc_id for r in index.search("plain").collect()] == [f"{tmp_path}/a.txt"]


def test_unreadable_rows(spark):
    files = spark.createDataFrame([("file:/x/a.txt", None)], "path string, content binary")
    _, bad = split_read_errors(extract_documents(files))
    assert rows(bad, "doc_id", "error") == [("/x/a.txt", "unreadable")]


def test_null_text_is_an_error(spark):
    docs = spark.createDataFrame([("d", None, None)], "doc_id string, text string, error string")
    good, bad = split_read_errors(docs)
    assert good.count() == 0 and rows(bad, "doc_id", "error") == [("d", "unreadable")]


def test_spread_scan(spark):
    small = spark.range(10).coalesce(1)
    assert spread_scan(small).rdd.getNumPartitions() > 1
    wide = spark.range(1000).repartition(4 * spark.sparkContext.defaultParallelism)
    assert spread_scan(wide) is wide


def test_frequencies_count_documents(corpus):
    found = document_frequency(term_frequency(corpus(["aa aa bb", "aa"]), AN))
    assert rows(found, "token", "df") == [("AA", 2), ("BB", 1)]
    assert found.agg(F.sum("df")).head()[0] == 3


def test_batches_and_logs_are_dealt_to_tasks_by_their_size(spark, corpus, tmp_path, monkeypatch):
    """no task holds what a scan split holds, however many bytes these are."""
    rows = [(i % 3, i, f"aa bb c{i} c{i % 2}") for i in range(12)]
    docs = up.in_order(spark.createDataFrame(rows, "doc_id long, seq long, text string"))
    expected = postings_of(up.batch_postings(docs, AN))
    monkeypatch.setattr(sizing, "TEXT_BYTES", 1)
    plan = up.batch_postings(docs, AN)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[doc_id#\d+L, seq#\d+L\], \d+", plan)
    assert postings_of(up.batch_postings(docs, AN)) == expected
    path = str(tmp_path / "log")
    spark.createDataFrame(
        [(i % 4, "aa", i, i % 2) for i in range(8)], "doc_id long, token string, tf long, ord long"
    ).write.parquet(path)
    log = spark.read.parquet(path)
    latest = postings_of(up.latest_postings(log.where("tf > 3")))
    monkeypatch.setattr(up, "LOG_FILE_BYTES", 0)
    monkeypatch.setattr(sizing, "TEXT_PARTITION_BYTES", max(1, sizing.input_bytes(log) // 50))
    dealt = up.latest_postings(log.where("tf > 3"))
    assert postings_of(dealt) == latest
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert int(re.search(r"RepartitionByExpression \[doc_id#\d+L, token#\d+\], (\d+)", plan)[1]) >= 50
