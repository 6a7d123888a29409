from types import SimpleNamespace

import pytest

from textlode.plans import sizing, storage
from textlode.sources.tables import read_table


class FakeSession:
    def __init__(self, master, folder=None):
        self.sparkContext = SimpleNamespace(master=master, applicationId="app")
        self.conf = SimpleNamespace(get=lambda key, default: folder or default)


def test_shared_dir_comes_from_the_session():
    assert storage.shared_dir(FakeSession("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        storage.shared_dir(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert storage.shared_dir(local) == storage.shared_dir(local)
    assert storage.new_folder(local, "x") != storage.new_folder(local, "x")


def test_width_grows_with_the_input(spark, monkeypatch):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    size = sizing.input_bytes(docs)
    assert 100_000 < size < 10_000_000
    cores = spark.sparkContext.defaultParallelism
    assert sizing.spread_by(docs, "doc_id").rdd.getNumPartitions() == max(4, 2 * cores)
    monkeypatch.setattr(sizing, "TEXT_PARTITION_BYTES", size // 99)
    assert sizing.spread_by(docs, "doc_id").rdd.getNumPartitions() >= 99
    made = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert sizing.spread_by(made, "doc_id").rdd.getNumPartitions() == max(4, 2 * cores)
