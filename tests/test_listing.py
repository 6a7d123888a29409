import os

import pytest

from textlode import Analyzer, TermIndex
from textlode.sources import listing
from textlode.sources.documents import read_documents, split_read_errors
from textlode.sources.index_tables import write_index


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    for name, text in {
        "plain.txt": "alpha", "_private.txt": "beta", ".hidden": "gamma", "empty.txt": "",
        "_dir/.more/deep.txt": "delta", ".git/x=1/page.html": "<p>epsilon</p>",
        "with blank/per%20cent ü.txt": "zeta", "_SUCCESS": "",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "none").mkdir()
    os.symlink(root, root / "loop")
    os.symlink(root / "plain.txt", root / "link.txt")
    return root


def names(rows, root):
    return sorted(os.path.relpath(r["doc_id"], root) for r in rows)


EVERY = sorted(
    ["plain.txt", "_private.txt", ".hidden", "empty.txt", "_dir/.more/deep.txt", "_SUCCESS",
     ".git/x=1/page.html", "with blank/per%20cent ü.txt"]
)


@pytest.mark.parametrize("frontier", [1, 2, 256])
def test_every_regular_file(spark, tree, monkeypatch, frontier):
    monkeypatch.setattr(listing, "FRONTIER", frontier)
    got = read_documents(spark, str(tree)).collect()
    assert names(got, tree) == EVERY
    texts = {os.path.relpath(r["doc_id"], tree): r["text"] for r in got}
    assert texts["empty.txt"] == "" and texts[".git/x=1/page.html"] == "epsilon "
    assert texts["with blank/per%20cent ü.txt"] == "zeta"


def test_uri_and_spark_listing(spark, tree):
    assert names(read_documents(spark, f"file://{tree}").collect(), tree) == EVERY
    few = names(read_documents(spark, str(tree), every_file=False).collect(), tree)
    assert "plain.txt" in few and ".hidden" not in few and "empty.txt" not in few


def test_folder_is_indexed_whole(spark, tree, tmp_path):
    docs, errors = split_read_errors(read_documents(spark, str(tree)))
    write_index(spark, docs, str(tmp_path / "i"), Analyzer())
    index = TermIndex.open(spark, str(tmp_path / "i"))
    assert errors.count() == 0 and index.snapshot.n_docs() == len(EVERY)
    for word, name in [("beta", "_private.txt"), ("gamma", ".hidden"), ("delta", "_dir/.more/deep.txt")]:
        assert names(index.search(word, 1).collect(), tree) == [name]


def test_lost_file_is_an_error_row(spark, tree):
    files = read_documents(spark, str(tree))
    (tree / "plain.txt").unlink()
    good, bad = split_read_errors(files)
    assert [r["error"] for r in bad.collect()] == ["unreadable"]
    assert good.count() == len(EVERY) - 1


def test_many_files_in_one_directory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "BATCH_ROWS", 7)
    for i in range(100):
        (tmp_path / f"{i}.txt").write_text("x" * i)
    files = listing.list_files(spark, str(tmp_path))
    assert files.count() == 100 and sum(r["length"] for r in files.collect()) == 4950


def test_no_files_and_no_directory(spark, tmp_path):
    assert read_documents(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="missing"):
        read_documents(spark, str(tmp_path / "missing")).count()
