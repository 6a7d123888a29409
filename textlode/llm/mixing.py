"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson number of times whose mean is the rate its
source needs to reach its share of the mixture; the number comes from a hash of
the identifier, so a repeated run gives the same mixture.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.plans.sizing import is_small

from .common import fresh
from .components import stored

SEED = "mix-1"
#: Without weights of its own a source counts with its size to this power.
POWER = 0.5
#: Poisson numbers of a larger mean are sums of numbers of at most this mean.
MEAN = 64.0
#: A table of rates of more sources than this is not broadcast.
BROADCAST_SOURCES = 10_000


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1): the first 52 bits of the MD5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def rates(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    weights: Mapping[str | None, float] | None = None,
) -> DataFrame:
    """(source, mass, rate) of each source; a null source is one of them.

    ``mass`` is the sum of code points of all its texts, one more for each document's
    end; ``rate`` = its share of the weights x mass of all / its mass.  ``weights``
    names the sources wanted, others get rate 0; by default the weight of a source is
    the square root of its mass.
    """
    size = F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long") + 1
    mass = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.sum(size).alias("mass"))
    if weights is None:
        weighted = mass.withColumn("weight", F.pow(F.col("mass").cast("double"), F.lit(POWER)))
    else:
        known = F.lit(0.0)
        for name, value in weights.items():
            known = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(known)
        weighted = mass.withColumn("weight", known)
    weighted = stored(weighted, "mass")
    total = weighted.agg(F.sum("mass").alias("mass"), F.sum("weight").alias("weight")).head()
    if not total["weight"]:
        return weighted.select("source", "mass", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / F.lit(total["weight"]) * F.lit(float(total["mass"])) / F.col("mass")
    return weighted.select("source", "mass", rate.alias("rate"))


def cumulative(mean: Column) -> Column:
    """Array of the Poisson distribution function at 0, 1, 2, ..., to where it is 1 in doubles."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 30).cast("int")
    zero = F.exp(-mean)
    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        c = state["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(state["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["all"])


def replicate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Mapping[str | None, float] | None = None,
    seed: str = SEED,
    copy: str | None = None,
    rate: str | None = None,
) -> DataFrame:
    """Rows of ``docs``, each as often as its Poisson number says, in a random order.

    The number of a document is the smallest k with a distribution function at k
    above a hash of seed and identifier.  All columns stay; ``copy`` (from 1) and
    ``rate`` name columns to add.  Rows with one identifier are repeated equally
    often.  A row without identifier goes by the MD5 of its text (null: empty), so such
    rows differ in number and place as their texts do.  No rows give no rows.
    """
    taken = {name: fresh(docs, name) for name in ("src", "cdf", "parts", "rate_", "copy_", "place")}
    found = rates(docs, source, text, weights).select("source", "rate")
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(MEAN)), F.lit(1)).cast("int")
    table = stored(
        found.withColumn("parts", parts)
        .withColumn("cdf", cumulative(F.col("rate") / F.col("parts")))
        .select(
            F.col("source").alias(taken["src"]),
            F.col("rate").alias(taken["rate_"]),
            F.col("parts").alias(taken["parts"]),
            F.col("cdf").alias(taken["cdf"]),
        ),
        "rates",
    )
    if is_small(table, BROADCAST_SOURCES):
        table = F.broadcast(table)
    joined = docs.join(
        table, F.col(source).cast("string").eqNullSafe(F.col(taken["src"])), "inner"
    )
    own = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    key = F.coalesce(F.col(doc_id).cast("string"), own)
    cdf = F.col(taken["cdf"])

    def number(part: Column) -> Column:
        u = hash_unit(F.lit(seed), part.cast("string"), key)
        return F.size(F.filter(cdf, lambda c: c <= u))

    numbers = F.transform(F.sequence(F.lit(0), F.col(taken["parts"]) - 1), number)
    n = F.when(F.col(taken["parts"]) == 1, number(F.lit(0))).otherwise(
        F.aggregate(numbers, F.lit(0), lambda a, b: a + b)
    )
    n = F.when(F.col(taken["rate_"]) > 0, n).otherwise(0)
    copies = (
        joined.withColumn(taken["copy_"], n)
        .where(F.col(taken["copy_"]) > 0)
        .withColumn(taken["copy_"], F.explode(F.sequence(F.lit(1), F.col(taken["copy_"]))))
    )
    place = F.xxhash64(F.lit(seed), key, F.col(taken["copy_"]))
    mixed = copies.withColumn(taken["place"], place)
    mixed = mixed.repartition(F.col(taken["place"])).sortWithinPartitions(taken["place"])
    kept = [F.col(c) for c in docs.columns]
    if copy:
        kept.append(F.col(taken["copy_"]).cast("long").alias(copy))
    if rate:
        kept.append(F.col(taken["rate_"]).alias(rate))
    return mixed.select(*kept)
