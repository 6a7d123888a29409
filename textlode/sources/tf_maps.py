"""Postings as JSON lines, one document per line: {"doc_id": .., "tf": {token: n}}."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a task sends on at a time.
BATCH_ENTRIES = 200_000
#: Types of keys that tasks read; Spark's reader, which takes names of entries for columns that
#: come again and remembers each, reads others.
KEY_TYPES = {"STRING": pa.string(), "LONG": pa.int64(), "BIGINT": pa.int64(), "INT": pa.int32()}


def tf_maps(postings: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, tf MAP<STRING,BIGINT>); a map is as large as its document's vocabulary.

    Documents of ``docs`` without tokens have an empty map.
    """
    entries = F.collect_list(F.struct("token", "tf"))
    maps = postings.groupBy("doc_id").agg(F.map_from_entries(entries).alias("tf"))
    if docs is None:
        return maps
    empty = F.map_from_entries(F.array().cast("array<struct<token:string,tf:bigint>>"))
    every = docs.select("doc_id").distinct().join(maps, "doc_id", "left")
    return every.select("doc_id", F.coalesce("tf", empty).alias("tf"))


def export_tf_maps(postings: DataFrame, path: str, docs: DataFrame | None = None) -> None:
    tf_maps(postings, docs).write.mode("overwrite").json(path)


def _lines(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    return spark.read.schema(f"doc_id {key_type}, tf MAP<STRING,BIGINT>").json(path)


def import_tf_maps(spark: SparkSession, path: str, key_type: str = "STRING") -> DataFrame:
    """Postings back from exported lines."""
    kind = KEY_TYPES.get(key_type.upper())
    if kind is None:
        return _lines(spark, path, key_type).select("doc_id", F.explode("tf").alias("token", "tf"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, tokens, tfs = [], [], [], []

        def made() -> pa.RecordBatch:
            of = np.repeat(np.arange(len(keys)), sizes)
            columns = [_keys(keys, kind).take(pa.array(of)), _texts(tokens), _numbers(tfs)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "token", "tf"])

        for key, terms in _objects(batches):
            if not terms:
                continue
            keys.append(key)
            sizes.append(len(terms))
            tokens.extend(terms)
            tfs.extend(terms.values())
            if len(tokens) >= BATCH_ENTRIES:
                yield made()
                keys, sizes, tokens, tfs = [], [], [], []
        if keys:
            yield made()

    return spark.read.text(path).mapInArrow(parse, f"doc_id {key_type}, token string, tf long")


def import_documents(spark: SparkSession, path: str, key_type: str = "STRING") -> DataFrame:
    """(doc_id, has_tokens) of every exported line, those with an empty map included."""
    kind = KEY_TYPES.get(key_type.upper())
    if kind is None:
        has = F.coalesce(F.size("tf") > 0, F.lit(False))
        return _lines(spark, path, key_type).select("doc_id", has.alias("has_tokens"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, bool(terms)) for key, terms in _objects([batch])]
            columns = [_keys([key for key, _ in rows], kind), pa.array([has for _, has in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "has_tokens"])

    return spark.read.text(path).mapInArrow(parse, f"doc_id {key_type}, has_tokens boolean")


def _objects(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, dict | None]]:
    """Key and map of every line that is not blank; nulls for what is no such object."""
    for batch in batches:
        for value in batch.column(0):
            line = value.as_py()
            if not line.strip():
                continue
            try:
                row = json.loads(line)
            except ValueError:
                row = None
            if not isinstance(row, dict):
                yield None, None
                continue
            terms = row.get("tf")
            yield row.get("doc_id"), terms if isinstance(terms, dict) else None


def _keys(keys: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_string(kind):
        return _texts([k if k is None or isinstance(k, str) else json.dumps(k) for k in keys])
    return _numbers(keys, kind)


def _numbers(values: list, kind: pa.DataType = pa.int64()) -> pa.Array:  # noqa: B008
    """Whole numbers of a kind; null for any other value."""
    try:
        if bool not in set(map(type, values)):
            return pa.array(values, kind)
    except (pa.ArrowException, OverflowError, TypeError):
        pass
    bound = 1 << kind.bit_width - 1
    return pa.array([v if type(v) is int and -bound <= v < bound else None for v in values], kind)


def _texts(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half of a pair of code units, which no text holds
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values])
