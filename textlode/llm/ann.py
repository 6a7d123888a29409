"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors of length one are hashed by the floors of Gaussian projections, several to
a table, several tables.  A query visits its own bucket of each table and those
reached by moving some projections over a near boundary, in the order of their
estimated success; candidates of all tables are merged and ranked by the exact
cosine of the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import stored

TABLES = 2
PROJECTIONS = 4
#: Width of a bucket; projections of unit vectors have deviation 1.
WIDTH = 2.0
#: Buckets a query visits in each table.
PROBES = 36
#: Further boundaries a projection may be moved over, either way.
REACH = 2
#: Codes are cut off here, so a table has a bounded number of buckets.
CODE = 8
NEAREST = 5
SEED = 20
#: Least and most vectors of one table's bucket that a task compares at a time.
BLOCK_ROWS = (256, 8192)
BLOCK_QUERIES = 4096


@lru_cache(maxsize=8)
def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (tables, dim, projections) and offsets for a dimension."""
    rng = np.random.default_rng((SEED, dim))
    return (
        rng.normal(size=(TABLES, dim, PROJECTIONS)),
        rng.uniform(0, WIDTH, (TABLES, PROJECTIONS)),
    )


def unit_rows(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by a power of two near their largest component, and their lengths."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    scaled = np.ldexp(vectors, -power[:, None])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


def positions(vectors: np.ndarray, table: int) -> np.ndarray:
    """Where each unit vector lies, in buckets, on the projections of a table."""
    scaled, norms = unit_rows(vectors)
    directions, offsets = projections(vectors.shape[1])
    return ((scaled / norms[:, None]) @ directions[table] + offsets[table]) / WIDTH


def codes(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of the projections."""
    kept = np.clip(cells, -CODE, CODE - 1).astype(np.int64) + CODE
    return (kept * (2 * CODE) ** np.arange(PROJECTIONS)).sum(axis=-1)


@lru_cache(maxsize=1)
def moves() -> np.ndarray:
    steps = range(-REACH, REACH + 1)
    return np.array(list(product(steps, repeat=PROJECTIONS)), np.int64)


def probes(at: np.ndarray) -> np.ndarray:
    """Codes of the buckets to visit for each position, most promising first.

    A bucket's score is the sum of squared distances to the boundaries on the way to
    it; the smaller, the likelier it holds a near vector.
    """
    cells = np.floor(at)
    inside = at - cells
    steps = np.arange(-REACH, REACH + 1)
    way = np.where(
        steps < 0, inside[..., None] - steps - 1, np.where(steps > 0, steps - inside[..., None], 0.0)
    )
    squares = way * way  # (rows, projections, steps)
    every = moves()
    score = sum(squares[:, j, every[:, j] + REACH] for j in range(PROJECTIONS))
    n = min(PROBES, len(every))
    nearest = np.argsort(score, axis=1, kind="stable")[:, :n]
    return codes(cells[:, None, :] + every[nearest])


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(name, v) of rows with an identifier and a finite vector that is not zero."""
    v = F.col("v")
    own = rows.select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return own.where(
        F.col(name).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))
        & F.exists(v, lambda x: x != 0)
    ).distinct()


def _hashed(vectors: DataFrame, query: bool) -> DataFrame:
    """(id, ids, v, dim, tab, code): a row for each bucket a vector lies in or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column(2)], np.int64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for start in range(0, len(rows), 2048):
                    part = batch.take(pa.array(rows[start : start + 2048]))
                    matrix = _matrix(part.column(2))
                    for table in range(TABLES):
                        at = positions(matrix, table)
                        found = probes(at) if query else codes(np.floor(at))[:, None]
                        n = found.shape[1]
                        own = part.take(pa.array(np.repeat(np.arange(len(part)), n)))
                        flat, first = found.ravel(), np.ones(found.size, bool)
                        if query:  # cut-off codes may meet
                            row = np.repeat(np.arange(len(part)), n)
                            first[:] = False
                            first[np.unique(row * (1 << 40) + flat, return_index=True)[1]] = True
                        made = [
                            *own.columns,
                            pa.array(np.full(len(own), dim)),
                            pa.array(np.full(len(own), table)),
                            pa.array(flat),
                        ]
                        names = ["id", "ids", "v", "dim", "tab", "code"]
                        yield pa.RecordBatch.from_arrays(made, names=names).filter(pa.array(first))

    return vectors.mapInArrow(
        run, "id long, ids array<long>, v array<double>, dim long, tab long, code long"
    )


def _best(queries: np.ndarray, rows: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, cosines) of the ``n`` nearest rows and all that tie with them, by position."""
    (q, q_norm), (x, x_norm) = unit_rows(queries), unit_rows(rows)
    near = (q @ x.T) / x_norm
    place = len(rows) - min(n, len(rows))
    # Products and cosines differ from the exact values by less than this.
    rounding = 8 * (rows.shape[1] + 2) * np.finfo(np.float64).eps * q_norm
    for i in range(len(queries)):
        # The measure itself is taken of all rows that may be among the nearest.
        top = np.flatnonzero(near[i] >= np.partition(near[i], place)[place] - rounding[i])
        exact = (x[top] * q[i]).sum(axis=1) / (x_norm[top] * q_norm[i])
        yield i, top, exact


def _compare(group: pa.Table, n: int) -> pa.Table:
    """The nearest rows of one block for each of its queries."""
    kind = group.column("kind").to_numpy()
    rows, queries = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
    schema = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    if not rows.num_rows or not queries.num_rows:
        return schema.empty_table()
    ids = rows.column("ids").to_pylist()
    names = queries.column("id").to_pylist()
    a = _matrix(queries.column("v").combine_chunks())
    b = _matrix(rows.column("v").combine_chunks())
    out: list[list] = [[], [], []]
    for i, top, exact in _best(a, b, n):
        order = heapq.nsmallest(
            n, range(len(top)), key=lambda j, e=exact, t=top: (-e[j], ids[t[j]][0])
        )
        for j in order:
            out[0].append(names[i])
            out[1].append(ids[top[j]])
            out[2].append(float(exact[j]))
    return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def nearest(
    index: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    n: int = NEAREST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``n`` nearest rows found for each query.

    ``queries`` has the columns ``key`` and ``vector`` as ``index`` has.  Score is the
    cosine of the original vectors in double precision; candidates are all rows with
    another identifier, ties go to the smaller one.  Null, zero and non-finite vectors,
    vectors with null components and rows without an identifier take no part; vectors
    are compared with those of their dimension; repeated rows count once.

    Equal vectors are hashed once, with their ``n + 1`` smallest identifiers: no more
    of them can be among the ``n`` nearest.  A bucket is compared in blocks: rows and
    queries of a bucket are split, so no task holds more than a block of either.
    """
    spark = index.sparkSession
    rows = usable(index, key, vector, "id")
    order = Window.partitionBy("v").orderBy("id")
    vectors = stored(
        rows.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= n + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("id"), "ids", "v"),
        "vectors",
    )
    asked = stored(usable(queries, key, vector, "query_id"), "queries")
    distinct = asked.groupBy("v").agg(F.min("query_id").alias("id"))
    members = asked.join(distinct, "v").select("query_id", F.col("id").alias("q"))
    one = distinct.select("id", F.array("id").alias("ids"), "v")

    bucket = ["dim", "tab", "code"]
    data, visits = stored(_hashed(vectors, False), "hashed"), stored(_hashed(one, True), "visits")
    wanted = vectors.count() * TABLES // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = min(max(wanted, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    # At most (2 * CODE) ** PROJECTIONS buckets a table and dimension.
    sizes = (
        data.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows"))
        .join(visits.groupBy(*bucket).agg(F.count(F.lit(1)).alias("asks")), bucket)
        .select(
            *bucket,
            F.ceil(F.col("rows") / block).alias("row_parts"),
            F.ceil(F.col("asks") / BLOCK_QUERIES).alias("ask_parts"),
        )
    )
    sizes = F.broadcast(stored(sizes, "sizes"))

    def part(parts: str):
        return F.pmod(F.xxhash64("id"), F.col(parts))

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))

    columns = [*bucket, "row_part", "ask_part"]
    dealt = (
        data.join(sizes, bucket)
        .withColumn("row_part", part("row_parts"))
        .withColumn("ask_part", every("ask_parts"))
        .select(*columns, F.lit(0).alias("kind"), "id", "ids", "v")
        .unionByName(
            visits.join(sizes, bucket)
            .withColumn("ask_part", part("ask_parts"))
            .withColumn("row_part", every("row_parts"))
            .select(*columns, F.lit(1).alias("kind"), "id", "ids", "v")
        )
    )
    found = dealt.groupBy(*columns).applyInArrow(
        lambda group: _compare(group, n + 1), "q long, ids array<long>, score double"
    )
    merged = found.groupBy("q", "ids").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    merged = merged.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= n + 1)
    expanded = members.join(merged, "q").select("query_id", F.explode("ids").alias("vec_id"), "score")
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        expanded.where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(ranking))
        .where(F.col("rank") <= n)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
