"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 ... n - 1 in the order of a key.  A Feistel network over pairs of
numbers below a and b, with a x b just above n, permutes the numbers; one that leaves the
range is sent through again until it is back (cycle walking).  The shard of a row is
its permuted number modulo the number of shards, its slot is the quotient, so both can be
computed from the row's number alone, and the number from both.

Column expressions only: no Python runs in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.plans.storage import stored

from .common import fresh

SEED = "shard-1"
SHARDS = 8
#: Rounds of the network; each changes one half by a hash of the other.
ROUNDS = 6
#: Rows of one shard that are written to one file.
FILE_ROWS = 1_000_000
#: Numbers of rows within a partition, as Spark numbers them.
_LOW_BITS = 33


def sides(n: int) -> tuple[int, int]:
    """(a, b): the least near-square with a x b >= n; it exceeds n by less than a."""
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    return a, max(1, -(-n // a))


def round_value(seed: str, number: Column, half: Column) -> Column:
    """The first 52 bits of the MD5 of seed, round and the other half."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), number, half))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _network(value: Column, n: int, seed: str, back: bool) -> Column:
    """One passage of a number through all rounds, or ``back`` through them."""
    a, b = sides(n)
    start = F.struct((value % a).alias("l"), F.call_function("div", value, F.lit(a)).alias("r"))
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    sign = -1 if back else 1

    def apply(state: Column, number: Column) -> Column:
        l, r = state["l"], state["r"]
        even = number % 2 == 0
        moved = F.when(even, l).otherwise(r)
        side = F.when(even, F.lit(a)).otherwise(F.lit(b)).cast("long")
        by = round_value(seed, number, F.when(even, r).otherwise(l)) % side
        moved = F.pmod(moved + sign * by, side)
        return F.struct(
            F.when(even, moved).otherwise(l).alias("l"), F.when(even, r).otherwise(moved).alias("r")
        )

    rounds = F.array(*(F.lit(j) for j in order))
    return F.aggregate(rounds, start, apply, lambda state: state["r"] * a + state["l"])


def _walked(value: Column, n: int, seed: str, back: bool) -> Column:
    """Passages until the number is below ``n`` again.

    A cycle leaves the range for at most a x b - n numbers in a row, so the walk is given
    that many passages, in two nested loops of the square root of it each: it always ends in
    range.  Only about one row in the square root of ``n`` walks at all.
    """
    a, b = sides(n)
    value = value.cast("long")
    first = _network(value, n, seed, back)
    outside = a * b - n
    if not outside:
        return first
    times = F.array(*(F.lit(i) for i in range(math.isqrt(outside - 1) + 1 if outside > 1 else 1)))

    def once(x: Column, _: Column) -> Column:
        return F.when(x < n, x).otherwise(_network(x, n, seed, back))

    def some(x: Column, _: Column) -> Column:
        return F.when(x < n, x).otherwise(F.aggregate(times, x, once))

    return F.when(first < n, first).otherwise(F.aggregate(times, first, some))


def permuted(number: Column, n: int, seed: str = SEED) -> Column:
    """The place in 0 ... n - 1 of row ``number``; different rows have different places."""
    return _walked(number, n, seed, back=False)


def restored(place: Column, n: int, seed: str = SEED) -> Column:
    """The row number whose place is ``place``."""
    return _walked(place, n, seed, back=True)


def shard_of(number: Column, n: int, shards: int = SHARDS, seed: str = SEED) -> Column:
    """Struct (shard, slot) of a row number; shards differ by one row at most."""
    place = permuted(number, n, seed)
    return F.struct(
        (place % shards).cast("int").alias("shard"),
        F.call_function("div", place, F.lit(shards)).alias("slot"),
    )


def row_of(shard: Column, slot: Column, n: int, shards: int = SHARDS, seed: str = SEED) -> Column:
    """The row number that lies in a slot of a shard."""
    return restored(slot.cast("long") * shards + shard, n, seed)


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` with their global number in the order of some columns, and how many there are.

    Rows that agree in ``order`` follow a hash of all columns; rows equal in everything may
    change places, which no result shows.  Ranges of the order are dealt to tasks, with a last
    key that is different for every row, so one value with any share of the rows is spread
    over tasks.  A number is that of the row within its task plus the rows of the tasks before:
    one row for each task is summed up, never one for each row.
    """
    tie, salt, at, begin = (fresh(rows, c) for c in ("tie", "salt", "at", "begin"))
    every = [F.col(f"`{c}`") for c in rows.columns]
    keys = [F.col(f"`{c}`") for c in order] + [F.col(tie), F.col(salt)]
    spread = (
        rows.withColumn(tie, F.xxhash64(*every))
        .withColumn(salt, F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
    )
    placed = stored(spread.select(*every, F.monotonically_increasing_id().alias(at)), "numbered")
    part = F.shiftrightunsigned(F.col(at), _LOW_BITS)
    counts = stored(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "counts")
    n = counts.agg(F.sum("n")).head()[0] or 0
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        F.col("part").alias(salt), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(begin)
    )
    # One row for each task of the shuffle above.
    joined = placed.join(F.broadcast(begins), part == F.col(salt))
    own = F.col(at).bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return joined.select(*every, (F.col(begin) + own).alias(name)), n


def sharded(
    rows: DataFrame,
    order: Sequence[str],
    shards: int = SHARDS,
    seed: str = SEED,
    shard: str = "shard",
    slot: str = "slot",
) -> DataFrame:
    """``rows`` with ``shard`` (0 ... shards - 1) and ``slot`` (from 0, without gaps).

    The order decides the row numbers, so the result does not depend on how the rows are
    stored.  Nulls come first in it.  No rows give no rows; fewer rows than shards leave the
    later shards empty.  A column of ``rows`` called ``shard`` or ``slot`` is replaced.
    """
    kept = [c for c in rows.columns if c.lower() not in (shard.lower(), slot.lower())]
    number = fresh(rows, "number")
    found, n = numbered(rows, order, number)
    place = shard_of(F.col(number), n, shards, seed)
    return found.withColumn(number, place).select(
        *(F.col(f"`{c}`") for c in kept),
        F.col(number)["shard"].alias(shard),
        F.col(number)["slot"].alias(slot),
    )


def write_shards(rows: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Rows of :func:`sharded` as Parquet folders ``shard=K``, each file in order of slots.

    Runs of ``FILE_ROWS`` slots are dealt to tasks, and a file holds so many rows at most, so
    no task or file holds a whole shard.
    """
    file = fresh(rows, "file")
    dealt = rows.withColumn(file, F.call_function("div", F.col(slot), F.lit(FILE_ROWS)))
    dealt = dealt.repartition(shard, file).sortWithinPartitions(shard, slot).drop(file)
    dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(shard).parquet(path)


def document_shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    The law is ``rows``: shards differ by one document at most, whatever the texts are; equal
    texts are documents like others.  Documents are numbered by identifier, then by the MD5 of
    the text; rows equal in both share their places among them.  A null text has size 1 and
    checksum 0, a null identifier comes first.  Texts are read once and never moved.
    """
    body = F.col(text).cast("string")
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(body.cast("binary")).alias("digest"),
    )
    placed = sharded(stored(narrow, "narrow"), ["doc_id", "digest"], shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
