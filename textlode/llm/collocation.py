"""Phrase collocations by double-array tries of candidates.

Frequent words get numbers and every text becomes one array of them.  Level by level, the
frequent phrases of k words are compiled into double-array tries of a bounded size, which are
broadcast; numpy moves the states of all text positions one word further at a time, counts
the accepting states, and notes which accepted phrases are followed by a word that may make
a frequent phrase of k + 1 words (its first k and its last k words must be frequent: Apriori).
Spark sums the counts of all shards of the text.
Counts travel as sorted arrays, one for each shard of the text and block of keys, so Spark
shuffles few large rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.plans.sizing import join_lookup
from textlode.plans.storage import stored

from .common import column_of
from .sharding import numbered

LEAST_COUNT = 100
MOST_WORDS = 5
TOP = 2_000
#: Language of documents without one.
NO_LANGUAGE = "und"
#: Phrases of one trie; more make several tries, each with a pass of its own.
TRIE_PHRASES = 400_000
#: Words of one dictionary that tasks get; more make several, each with a pass of its own.
DICTIONARY_WORDS = 1_000_000
#: Hashed ends of frequent phrases: a table of fixed size, whatever the number of phrases.
ENDS = 1 << 24
#: Places for a node's children that are tried at a time.
TRIES = 64
#: Least number of blocks of keys, and positions of text for each block.
BLOCKS = 256
BLOCK_POSITIONS = 1 << 22
#: Positions of one stored row, and keys that a task counts at a time.
CHUNK = 1 << 18
HELD_KEYS = 1 << 21
HELD_WORDS = 300_000
PIECE_BYTES = 4_000_000
#: Parts that a language's phrases are ranked in first.
RANK_PARTS = 64

FILLED = pa.schema(
    [("lang", pa.string()), ("body", pa.binary()), ("ids", pa.binary()), ("ends", pa.bool_())]
)
CHUNKS = pa.schema([("ids", pa.binary()), ("starts", pa.int32())])

#: Bytes that end a piece, in the contract of the operator.
ENDINGS = b".,;:!?\n\x0b\x0c\r"
#: Mark of a piece's end; no text in UTF-8 has this byte.
BREAK = b"\xff"
_FOLD = bytes.maketrans(
    bytes(range(65, 91)) + b"\t" + ENDINGS, bytes(range(97, 123)) + b" " + BREAK * len(ENDINGS)
)


# -- words and numbers -----------------------------------------------------
def words_of(text: str) -> Iterator[list[bytes]]:
    """Words of a text in UTF-8, only A-Z in lower case, with ``BREAK`` between pieces."""
    data = text.encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        end = len(data) if end >= len(data) else data.find(b" ", end) + 1 or len(data)
        yield data[at:end].replace(BREAK, b" \xff ").split()
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of documents (lang, text), each word's occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in total.items():
                counts.pop(BREAK, None)
                words = pa.array(list(counts), pa.binary()).cast(pa.string())
                names = pa.array([lang] * len(words), pa.string())
                made = [names, words, pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["lang", "word", "n"])
            total.clear()

        for batch in batches:
            langs = column_of(batch, "lang").to_pylist()
            for lang, text in zip(langs, column_of(batch, "text"), strict=True):
                counts = total.setdefault(lang, Counter())
                for words in words_of(text.as_py()):
                    counts.update(words)
                if sum(map(len, total.values())) >= HELD_WORDS:
                    yield from flush()
        yield from flush()

    rows = docs.mapInArrow(run, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered_texts(docs: DataFrame, words: DataFrame, n_words: int, look: int) -> DataFrame:
    """(ids binary, starts): texts as numbers of frequent words, end to end, in rows of ``CHUNK``.

    0 stands for any other word and for the end of a piece or text, so no phrase goes over it.
    The last ``look`` numbers of a row are the first of the next row again; phrases may run
    into them but ``starts`` says at how many positions phrases of the row begin.

    The dictionary (lang, word, id) goes to tasks in parts of ``DICTIONARY_WORDS``; a second
    part and those after it take the rows of the part before, which then keep their words.
    """
    parts = max(1, -(-n_words // DICTIONARY_WORDS))
    rows = docs
    for part in range(parts):
        own = words.where(F.col("id") % parts == part).select("lang", "word", "id").toArrow()
        known: dict[str, dict[bytes, int]] = {}
        listed = own.column("word").cast(pa.binary()).to_pylist()
        for lang, word, number in zip(
            own.column("lang").to_pylist(), listed, own.column("id").to_pylist(), strict=True
        ):
            known.setdefault(lang, {})[word] = number + 1
        table = docs.sparkSession.sparkContext.broadcast(known)
        if part < parts - 1:
            rows = stored(_filled(rows, table, part == 0), "filled")
        else:
            rows = _chunked(rows, table, part == 0, look)
    return stored(rows, "ids")


def _numbers(lang: str, words: Sequence[bytes], known: dict, before: bytes | None) -> np.ndarray:
    look = known.get(lang, {}).get
    ids = np.fromiter((look(w, 0) for w in words), np.int32, len(words))
    return ids if before is None else ids | np.frombuffer(before, np.int32)


def _texts(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[tuple[str, list[bytes], bytes | None, bool]]:
    """(lang, words, numbers so far, whether the text ends here)."""
    for batch in batches:
        for values in zip(*batch.columns, strict=True):
            row = {f.name: value.as_py() for f, value in zip(batch.schema, values, strict=True)}
            if not first:
                yield row["lang"], row["body"].split(), row["ids"], row["ends"]
                continue
            held: list[bytes] | None = None
            for words in words_of(row["text"]):
                if held is not None:
                    yield row["lang"], held, None, False
                held = words
            yield row["lang"], held or [], None, True


def _filled(rows: DataFrame, table, first: bool) -> DataFrame:
    """(lang, body, ids, ends): words with the numbers that the dictionaries so far give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, before, ends in _texts(batches, first):
            ids = _numbers(lang, words, table.value, before)
            row = {"lang": lang, "body": b" ".join(words), "ids": ids.tobytes(), "ends": ends}
            yield pa.RecordBatch.from_pylist([row], FILLED)

    return rows.mapInArrow(run, "lang string, body binary, ids binary, ends boolean")


def _chunked(rows: DataFrame, table, first: bool, look: int) -> DataFrame:
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, end = zstandard.ZstdCompressor(level=1).compress, np.zeros(1, np.int32)
        held: list[np.ndarray] = []
        size = 0

        def row(ids: np.ndarray, starts: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"ids": pack(ids.tobytes()), "starts": starts}], CHUNKS)

        for lang, words, before, ends in _texts(batches, first):
            held.append(_numbers(lang, words, table.value, before))
            size += len(words)
            if ends:
                held.append(end)
                size += 1
            if size >= chunk + look:
                ids = np.concatenate(held)
                while len(ids) >= chunk + look:
                    yield row(ids[: chunk + look], chunk)
                    ids = ids[chunk:]
                held, size = [ids], len(ids)
        if size:
            ids = np.concatenate(held)
            yield row(np.concatenate([ids, np.zeros(look, np.int32)]), len(ids))

    return rows.mapInArrow(run, "ids binary, starts int")


# -- tries -----------------------------------------------------------------
class DoubleArray:
    """Trie over rows of numbers as two arrays.

    From state s a number w leads to t = base[s] + w if check[t] is s.  ``accept`` has the
    row that ends in a state, or -1.  The root is state 0; all rows have one length.
    """

    def __init__(self, phrases: np.ndarray):
        self.phrases = phrases = np.unique(np.asarray(phrases, np.int32), axis=0)
        n, depth = phrases.shape
        # Where a row differs from the row before, at which depth first.
        new = np.ones((n, depth), bool)
        if n > 1:
            new[1:] = np.logical_or.accumulate(phrases[1:] != phrases[:-1], axis=1)
        total = int(new.sum())
        span = int(phrases.max(initial=0)) + 2
        self._rng = np.random.default_rng(13)
        self.base = np.zeros(2 * total + span, np.int64)
        self.check = np.full(2 * total + span, -1, np.int64)
        self.check[0] = 0  # the root's own place
        parents = np.zeros(n, np.int64)
        for level in range(depth):
            rows = np.flatnonzero(new[:, level])
            places = np.zeros(n, np.int64)
            places[rows] = self._place(parents[rows], phrases[rows, level].astype(np.int64))
            # A row's state is that of the last row above it that began a node.
            parents = places[np.maximum.accumulate(np.where(new[:, level], np.arange(n), 0))]
        self.accept = np.full(len(self.check), -1, np.int32)
        self.accept[parents] = np.arange(n)
        self.base, self.check = self.base.astype(np.int32), self.check.astype(np.int32)
        self.check[0] = -1

    def _place(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """States for the children of some nodes, nodes with most children first."""
        states = np.zeros(len(words), np.int64)
        if not len(words):
            return states
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        sizes = np.diff(np.r_[starts, len(words)])
        for i in np.argsort(-sizes, kind="stable").tolist():
            if sizes[i] == 1:
                break
            a, b = starts[i], starts[i] + sizes[i]
            base = self._room(words[a:b])
            self.base[parents[a]] = base
            states[a:b] = base + words[a:b]
            self.check[states[a:b]] = parents[a]
        # A single child fits any free place.
        single = starts[sizes == 1]
        free = np.flatnonzero(self.check < 0)
        while len(free) < len(single):
            self._grow(len(self.check))
            free = np.flatnonzero(self.check < 0)
        states[single] = free[: len(single)]
        self.base[parents[single]] = states[single] - words[single]
        self.check[states[single]] = parents[single]
        return states

    def _room(self, words: np.ndarray) -> int:
        """A base that leads all words to free places."""
        low, high = int(words[0]), int(words[-1])
        for _ in range(4):
            bases = self._rng.integers(1 - low, len(self.check) - high, TRIES)
            ok = (self.check[bases[:, None] + words] < 0).all(axis=1)
            if ok.any():
                return int(bases[ok.argmax()])
        end = len(self.check)
        self._grow(high - low + 1)
        return end - low

    def _grow(self, more: int) -> None:
        self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def accepted(self, ids: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, row) of every occurrence of a row that begins before ``starts``."""
        at = np.arange(starts)
        states = np.zeros(starts, np.int32)
        last = len(self.check) - 1
        for level in range(self.phrases.shape[1]):
            word = ids[at + level]
            to = self.base[states] + word
            ok = (word > 0) & (to > 0) & (to <= last)
            ok &= self.check[np.clip(to, 0, last)] == states
            at, states = at[ok], to[ok]
        return at, self.accept[states]


def end_places(columns: Sequence[np.ndarray], size: int) -> np.ndarray:
    """Places of phrases, given word by word, in a table of ends; its size is a power of two."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for column in columns:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(size - 1)).astype(np.int64)


def advanced(texts: DataFrame, trie, ends, extend: bool, blocks: int) -> DataFrame:
    """(block, keys, counts): how often each task has the trie's phrases and what follows them.

    A key is (row of the trie, next): ``next`` 0 stands for all occurrences of a phrase, another
    for a word behind it that may make a frequent phrase: the phrase without its first word,
    with ``next``, has its place in ``ends``.
    """
    depth = trie.value.phrases.shape[1]
    most_held = HELD_KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, table = trie.value, ends.value if extend else None
        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros(len(tree.phrases), np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for packed, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(unpack(packed), np.int32)
                at, row = tree.accepted(ids, starts)
                total += np.bincount(row, minlength=len(total))
                if not extend:
                    continue
                following = ids[at + depth]
                ok = following > 0
                at, row, following = at[ok], row[ok], following[ok]
                ok = table[end_places([ids[at + i] for i in range(1, depth + 1)], len(table))]
                held.append(row[ok].astype(np.int64) << 32 | following[ok])
                size += len(held[-1])
                if size >= most_held:
                    yield _dealt(*np.unique(np.concatenate(held), return_counts=True), blocks)
                    held, size = [], 0
        if held:
            yield _dealt(*np.unique(np.concatenate(held), return_counts=True), blocks)
        at = np.flatnonzero(total)
        yield _dealt(at << 32, total[at], blocks)

    return texts.select("ids", "starts").mapInArrow(run, "block int, keys binary, counts binary")


def _dealt(keys: np.ndarray, counts: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Sorted keys and their counts by block; keys as differences."""
    place = (keys.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    place = (place % np.uint64(blocks)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    keys, counts, place = keys[order], counts[order], place[order]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
    edges = [*starts.tolist(), len(place)]
    cuts = list(zip(edges, edges[1:], strict=False))
    steps = [np.diff(keys[a:b], prepend=0).tobytes() for a, b in cuts]
    numbers = [counts[a:b].astype(np.int64).tobytes() for a, b in cuts]
    made = [pa.array(place[starts]), pa.array(steps, pa.binary()), pa.array(numbers, pa.binary())]
    return pa.RecordBatch.from_arrays(made, names=["block", "keys", "counts"])


def summed(dealt: DataFrame, trie, least: int) -> DataFrame:
    """(w1 ... wk, next, f) of the keys that all shards have ``least`` times together.

    A task takes a block at a time: at most ``BLOCK_POSITIONS`` positions' keys in the mean.
    """
    depth = trie.value.phrases.shape[1]
    names = [*(f"w{i + 1}" for i in range(depth)), "next", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = trie.value.phrases
        block, keys, counts = None, [], []

        def close() -> pa.RecordBatch:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            f = np.zeros(len(key), np.int64)
            np.add.at(f, back, np.concatenate(counts))
            key, f = key[f >= least], f[f >= least]
            columns = [*phrases[key >> 32].T, (key & 0xFFFFFFFF).astype(np.int32)]
            made = [pa.array(np.ascontiguousarray(c)) for c in columns]
            return pa.RecordBatch.from_arrays([*made, pa.array(f)], names=names)

        for batch in batches:
            for at, steps, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != block and keys:
                    yield close()
                    keys, counts = [], []
                block = at
                keys.append(np.cumsum(np.frombuffer(steps, np.int64)))
                counts.append(np.frombuffer(n, np.int64))
        if keys:
            yield close()

    fields = ", ".join(f"{name} int" for name in names[:-1])
    rows = dealt.repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(run, f"{fields}, f long")


def phrase_counts(
    spark: SparkSession, texts: DataFrame, words: DataFrame, least: int, most: int
) -> DataFrame:
    """(ids, f): frequent phrases of 1 to ``most`` words as arrays of numbers."""
    level = words.select((F.col("id") + 1).cast("int").alias("w1"))
    positions = texts.agg(F.sum("starts")).head()[0] or 0
    blocks = max(BLOCKS, positions // BLOCK_POSITIONS)
    counted: list[DataFrame] = []
    for k in range(1, most + 1):
        names = [f"w{i + 1}" for i in range(k)]
        n = level.count()
        if not n:
            break
        shards = -(-n // TRIE_PHRASES)
        place = F.pmod(F.xxhash64(*names), F.lit(shards))
        tries, ends = [], np.zeros(ENDS, bool)
        for shard in range(shards):
            own = level.where(place == shard).select(*names).toArrow()
            if own.num_rows:
                phrases = np.stack([c.to_numpy() for c in own.columns], axis=1)
                ends[end_places(phrases.T, ENDS)] = True
                tries.append(spark.sparkContext.broadcast(DoubleArray(phrases)))
        table = spark.sparkContext.broadcast(ends)
        passes = [
            summed(advanced(texts, trie, table, k < most, blocks), trie, least) for trie in tries
        ]
        found = stored(reduce(DataFrame.unionByName, passes), f"phrases{k}")
        counted.append(found.where("next = 0").select(F.array(*names).alias("ids"), "f"))
        level = found.where("next > 0").select(*names, F.col("next").alias(f"w{k + 1}"))
        for trie in (*tries, table):
            trie.unpersist()
    if not counted:
        return spark.createDataFrame([], "ids array<int>, f long")
    return reduce(DataFrame.unionByName, counted)


# -- scores ----------------------------------------------------------------
def _score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)); whole numbers of up to 38 digits, so it is exact."""
    above = (a * 1000).cast("decimal(19,0)") * n.cast("decimal(19,0)")
    below = l.cast("decimal(19,0)") * r.cast("decimal(19,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), below.cast("decimal(38,0)")).cast("long")


def scored(phrases: DataFrame) -> DataFrame:
    """(ids, a, lang, n, l, r, score) of phrases (ids, f, lang, n) of two words and more.

    The cut of the lowest score counts, of equals the first.
    """
    size = F.size("ids")
    cuts = phrases.where(size > 1).select(
        "ids", F.col("f").alias("a"), "lang", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    )
    cuts = cuts.withColumn("first", F.slice("ids", F.lit(1), F.col("k"))).withColumn(
        "rest", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))
    )
    parts = stored(phrases.select("ids", "f"), "parts")
    first = parts.select(F.col("ids").alias("first"), F.col("f").alias("l"))
    rest = parts.select(F.col("ids").alias("rest"), F.col("f").alias("r"))
    joined = join_lookup(join_lookup(cuts, first, ["first"]), rest, ["rest"])
    made = joined.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = made.groupBy("ids").agg(
        F.max("a").alias("a"), F.max("lang").alias("lang"), F.max("n").alias("n"), lowest
    )
    return best.select("ids", "a", "lang", "n", "cut.l", "cut.r", "cut.score")


def not_inside(phrases: DataFrame, every: DataFrame) -> DataFrame:
    """``phrases`` (ids, a, ...) that no longer phrase of ``every`` (ids, f) holds as often.

    A phrase within one two words longer is within one a word longer that occurs no less
    often, so it is enough to look at both phrases that a phrase has without an end.
    """
    size = F.size("ids")
    long = every.where(size > 2)
    inner = F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))
    held = long.select(F.explode(inner).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("most"))
    joined = join_lookup(phrases, held, ["ids"], "left")
    return joined.where("most IS NULL OR most < a").drop("most")


def top_of_language(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank; ranked in parts first."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    parts = Window.partitionBy("lang", "part").orderBy(*order)
    kept = rows.withColumn("part", part).withColumn("rank", F.row_number().over(parts))
    kept = kept.where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    least: int = LEAST_COUNT,
    most: int = MOST_WORDS,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    A null text is empty, a null language is ``und``; everything is counted over all documents
    of a language, repeated rows as often as they occur.  No frequent phrase gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.col(text).cast("string").alias("text"),
    ).where(F.col("text").isNotNull())
    counts = stored(word_counts(texts), "words")
    totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = counts.where(F.col("n") >= least).select("lang", "word")
    words, n_words = numbered(frequent, ["lang", "word"], "id")
    words = stored(words, "dictionary")
    ids = numbered_texts(texts, words, n_words, most)
    phrases = stored(phrase_counts(spark, ids, words, least, most), "phrases")
    number = (F.col("id") + 1).cast("int").alias("w")
    of_word = join_lookup(words.select("lang", number), totals, ["lang"])
    known = join_lookup(phrases.withColumn("w", F.col("ids")[0]), of_word, ["w"]).drop("w")
    kept = stored(not_inside(scored(known), phrases), "kept")
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "w"))
    spelled = join_lookup(spelled, words.select(number, "word"), ["w"]).groupBy("ids").agg(
        F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words")
    )
    phrase = F.array_join(F.col("words.word"), " ").alias("phrase")
    rows = join_lookup(kept, spelled.select("ids", phrase), ["ids"])
    return top_of_language(rows, top)
