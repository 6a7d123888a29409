"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments.  The perfect Golay code
(23, 12) puts every 23-bit word within three bits of exactly one codeword; a
word and its neighbours at one bit decode to one or to six codewords.  Two words
that differ in at most two bits have a common neighbour, hence a common
codeword; of two that differ in one bit, each one's own codeword is among those
of the other.  Four differing bits in three segments leave two cases:

* some segment is equal, and of the two others one differs in at most two bits:
  key = the equal segment and a codeword near the other one;
* no segment is equal, then two segments differ in exactly one bit each: key =
  own codeword of one segment with a nearby codeword of the other, met by the
  same pair the other way round.

So every pair within four bits shares a key of its case, and each pair is
reported for one case only.  Candidates are verified by their bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, texts_of
from .components import components, stored

SEED = 42
MAX_BITS = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code.
GENERATOR = 0b101011100011
#: Shingles whose hashes are held at a time.
BLOCK = 1 << 16
PAIRS = ((0, 1), (0, 2), (1, 2))


# -- fingerprints ----------------------------------------------------------
def fingerprint(text: str, shingle: int = 4) -> int:
    """Fingerprint of a text as an unsigned number; see :func:`fingerprints`."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = np.array(
            [
                digest(joined[a:b], SEED)
                for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)
            ],
            np.uint64,
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, name: str, shingle: int = 4) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed BIGINT column ``name``.

    A-Z becomes lower case, words are ``[^\\x20\\x09-\\x0D]+``, shingles of ``shingle``
    words, repeats included, are joined by one space (fewer words: all of them) and
    hashed with XXH64, seed 42; a bit is 1 if set in over half of the hashes.  Null,
    empty and blank texts have fingerprint zero.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        values = [fingerprint(value, shingle) for value in texts_of(batch, text)]
        return [pa.array(np.array(values, np.uint64).view(np.int64))]

    return append_columns(docs, compute, [(name, T.LongType())])


# -- Golay keys ------------------------------------------------------------
def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of single bits; error pattern of at most three bits per remainder."""
    single = np.array([_remainder(1 << i) for i in range(23)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for i in range(23):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return single, errors


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    single, errors = _tables()
    rest = np.zeros_like(words)
    for bit in range(23):
        rest ^= np.where(words >> bit & 1, single[bit], 0)
    return (words ^ errors[rest]) >> 11


def nearby(words: np.ndarray, width: int) -> np.ndarray:
    """Indices for each word and its neighbours in ``width`` bits; repeats are -1."""
    found = np.stack([decode(words), *(decode(words ^ (1 << i)) for i in range(width))], axis=1)
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys_of(prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(side, row, key) arrays of fingerprints.  Side 2 meets itself, side 0 meets side 1."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [decode(part) for part in parts]
    near = [nearby(part, n) for part, (_, n) in zip(parts, SEGMENTS, strict=True)]

    def spread(side: int, kind: int, high: np.ndarray, low: np.ndarray):
        keys = kind << 40 | high << 12 | low
        row, column = np.nonzero((high >= 0) & (low >= 0))
        return side, row, keys[row, column]

    for a in range(3):
        for b in range(3):
            if a != b:
                yield spread(2, 3 * a + b, parts[a][:, None], near[b])
    for kind, (a, b) in enumerate(PAIRS, 16):
        yield spread(0, kind, own[a][:, None], near[b])
        yield spread(1, kind, near[a], own[b][:, None])


def _keyed(prints: DataFrame, sides: tuple[int, ...]) -> DataFrame:
    """Rows (key, fp, group) of the wanted sides from rows (fp, group)."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            group = batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                part, groups = fp[at : at + 4096], group[at : at + 4096]
                for side, row, key in keys_of(part.view(np.uint64)):
                    if side in sides:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), pa.array(part[row]), pa.array(groups[row])],
                            names=["key", "fp", "grp"],
                        )

    return prints.mapInArrow(run, "key long, fp long, grp long")


# -- links -----------------------------------------------------------------
def _distance(a: Column, b: Column, segment: int | None = None) -> Column:
    differing = a.bitwiseXOR(b)
    if segment is not None:
        at, width = SEGMENTS[segment]
        differing = F.shiftrightunsigned(differing, at).bitwiseAND(F.lit((1 << width) - 1))
    return F.bit_count(differing)


def _case(a: Column, b: Column) -> Column:
    """The one kind of key for which a pair within the distance is reported."""
    d = [_distance(a, b, i) for i in range(3)]
    kind = F.lit(-1)
    for number, (i, j) in reversed(list(enumerate(PAIRS, 16))):
        kind = F.when((d[i] == 1) & (d[j] == 1), number).otherwise(kind)
    for i in reversed(range(3)):
        j, k = (x for x in range(3) if x != i)
        closer = F.when(d[j] <= d[k], 3 * i + j).otherwise(3 * i + k)
        kind = F.when(d[i] == 0, closer).otherwise(kind)
    return kind


def _hub_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links between each fingerprint and the smallest of its key, where near enough.

    They join most of a dense group, one row for each member and key, before any
    pairs are looked for.  Spark takes keys for as few as the fingerprints they are made of
    and would broadcast them, some sixty rows for each, so the join is a merge.
    """
    keyed = _keyed(prints, (2,)).select("key", "fp")
    hubs = keyed.groupBy("key").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n"))
    met = keyed.join(hubs.where("n > 1").select("key", "hub").hint("merge"), "key")
    near = _distance(F.col("fp"), F.col("hub")) <= max_bits
    return met.where((F.col("fp") != F.col("hub")) & near).select("fp", "hub").distinct()


def _cross_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): groups that hold fingerprints within the distance of each other.

    Keys are merged, never broadcast: see :func:`_hub_links`.
    """
    left = _keyed(prints, (0, 2)).toDF("key", "fp", "grp")
    right = _keyed(prints, (1, 2)).toDF("key2", "fp2", "grp2")
    a, b = F.col("fp"), F.col("fp2")
    pairs = left.join(
        right.hint("merge"),
        (F.col("key") == F.col("key2"))
        & (a < b)
        & (F.col("grp") != F.col("grp2"))
        & (_distance(a, b) <= max_bits)
        & (_case(a, b) == F.shiftrightunsigned("key", 40)),
    )
    return pairs.select(
        F.least("grp", "grp2").alias("a"), F.greatest("grp", "grp2").alias("b")
    ).distinct()


def link_groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) of every distinct fingerprint in the one column of ``prints``.

    ``root`` is one fingerprint for all that links of at most ``max_bits`` (up to 4)
    differing bits connect.  First each key links its members to its smallest, then
    pairs are joined between the groups that are still apart.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find pairs of at most {MAX_BITS} differing bits")
    (column,) = prints.columns
    single = prints.select(F.col(column).alias("fp"))
    linked = components(_hub_links(single.select("fp", F.col("fp").alias("grp")), max_bits))
    grouped = stored(
        single.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("grp")
        ),
        "groups",
    )
    across = components(_cross_links(grouped, max_bits))
    return grouped.join(
        across.select(F.col("node").alias("grp"), "root"), "grp", "left"
    ).select("fp", F.coalesce("root", "grp").alias("root"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` has 16 hexadecimal digits; documents link when their fingerprints
    differ in at most ``max_bits`` bits, and ``component_id`` is the smallest
    identifier that links reach, the document's own included.  Texts without words
    have fingerprint zero and link like any other.  Repeated rows are each returned;
    rows with a null identifier link but never name a component (null if a component
    has no other).  No rows give no rows.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stored(fingerprints(source, "text", "fp", shingle).select("doc_id", "fp"), "prints")
    single = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = stored(link_groups(single.select("fp"), max_bits), "roots")
    named = single.join(roots, "fp")
    component = named.groupBy("root").agg(F.min("first").alias("component_id"))
    lookup = roots.join(component, "root").select("fp", "component_id")
    return prints.join(lookup, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_bits: int = MAX_BITS,
    repeats: bool = True,
) -> DataFrame:
    """One row of ``docs`` for each component, the one with the smallest identifier; all columns.

    Rows decide, not identifiers: of one identifier with two texts, each counts in its
    own component.  Rows without an identifier come last, so one is kept only if its
    component has no row with one.  ``repeats`` also keeps the other rows with both the
    identifier and the fingerprint of the kept one.
    """
    row, fp = fresh(docs, "row"), fresh(docs, "fp")
    # The numbers of rows hold only once they are stored.
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    rows = stored(fingerprints(numbered, text, fp, shingle), "rows")
    keyed = rows.select(
        F.col(fp).alias("fp"),
        F.struct(
            F.col(doc_id).isNull().alias("unnamed"),
            F.col(doc_id).alias("doc_id"),
            F.col(fp).alias("fp"),
            F.col(row).alias("row"),
        ).alias("key"),
    )
    single = stored(keyed.groupBy("fp").agg(F.min("key").alias("key")), "distinct")
    roots = link_groups(single.select("fp"), max_bits)
    first = single.join(roots, "fp").groupBy("root").agg(F.min("key").alias("key"))
    first = first.select("key.*").toDF("unnamed", "first_id", "first_fp", "first_row")
    first = stored(first, "first").toDF(*(fresh(rows, c) for c in first.columns))
    _, first_id, first_fp, first_row = (first[c] for c in first.columns)
    kept = rows.join(first, rows[row] == first_row, "left_semi")
    if repeats:
        again = (rows[doc_id] == first_id) & (rows[fp] == first_fp)
        kept = kept.where(F.col(doc_id).isNull()).union(rows.join(first, again, "left_semi"))
    return kept.select(*docs.columns)
