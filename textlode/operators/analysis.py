"""From text to index tokens.

An :class:`Analyzer` holds the parameters of the analysis and applies the same
steps to documents and to queries: tokenise, upper-case, drop stopwords, stem,
add n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.functions import bytemode, text as tx
from textlode.functions.stopwords import load_stopwords
from textlode.plans.sizing import join_lookup, spread_width
from textlode.plans.storage import new_folder, stored


@dataclass(frozen=True)
class Analyzer:
    """Parameters of the text analysis.

    mode        ``unicode`` cuts by code points, ``bytes`` by UTF-8 bytes.
    tokenizer   Column of text -> Column of array<string>; default `tokenize`.
    stemmer     Column of one upper-case token -> Column of its stem.
    vocabulary_stemmer
                DataFrame(word) -> DataFrame(word, stem), run once over the
                distinct words and joined back; takes the stemmer's place.
    stopwords   words dropped after upper-casing, or a DataFrame(word).
    gram_sizes  lengths of the n-grams added to every token.
    """

    mode: str = "unicode"
    tokenizer: Callable[[Column], Column] | None = None
    stemmer: Callable[[Column], Column] | None = None
    vocabulary_stemmer: Callable[[DataFrame], DataFrame] | None = None
    stopwords: Sequence[str] | DataFrame = field(default_factory=load_stopwords)
    gram_sizes: Sequence[int] = tx.GRAM_SIZES

    def __post_init__(self):
        if self.mode not in ("unicode", "bytes"):
            raise ValueError(f"unknown text mode {self.mode!r}")

    # -- single steps ------------------------------------------------------
    def tokenize(self, text: Column) -> Column:
        if self.mode == "bytes":
            text = bytemode.to_byte_form(text)
        return (self.tokenizer or tx.tokenize)(text)

    def normalize(self, token: Column) -> Column:
        if self.mode == "bytes":
            return bytemode.upper_byte_form(token)
        if self.tokenizer is None:
            # Default tokens hold no white space, and the sharp s was mapped
            # on the whole text, so this is all `normalize_case` has to do.
            return F.upper(token)
        return tx.normalize_case(token)

    def stem(self, token: Column) -> Column:
        if self.stemmer is not None:
            return self.stemmer(token)
        if self.mode == "bytes":
            return bytemode.stem_final_y_bytes(token)
        return tx.stem_final_y(token)

    # -- array form --------------------------------------------------------
    def analyze(self, text: Column) -> Column:
        """All index tokens of a text as one array, in order."""
        words, stem = self._kept_array(text)
        return F.flatten(
            F.transform(words, lambda w: tx.with_ngrams(stem(w), self.gram_sizes))
        )

    def word_array(self, text: Column) -> Column:
        """The stemmed words of a text as one array, in order, without their n-grams."""
        words, stem = self._kept_array(text)
        return F.transform(words, stem)

    def _kept_array(self, text: Column) -> tuple[Column, Callable[[Column], Column]]:
        """Upper-case words that are not stopwords, and how one of them is stemmed."""
        if self.vocabulary_stemmer is not None or isinstance(self.stopwords, DataFrame):
            raise ValueError("table-driven steps need the row form: use tokens()")
        words = F.transform(self.tokenize(self._prepared(text)), self.normalize)
        words = tx.remove_stopwords(words, self.stopwords)
        if self.mode == "bytes":
            return words, lambda w: bytemode.to_byte_form(self.stem(w))
        return words, self.stem

    @property
    def plain(self) -> bool:
        """Whether every step but the stopword list and the n-grams' sizes is the default one."""
        return (
            self.mode == "unicode" and self.tokenizer is None and self.stemmer is None
            and self.vocabulary_stemmer is None and not isinstance(self.stopwords, DataFrame)
            and all(size > 0 for size in self.gram_sizes)
        )

    # -- row form ----------------------------------------------------------
    def kept_words(self, docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
        """(keys, word): upper-case words that are not stopwords."""
        raw = docs.select(
            *keys, F.explode(self.tokenize(self._prepared(F.col(text)))).alias("word")
        )
        words = raw.withColumn("word", self.normalize(F.col("word")))
        return self._without_stopwords(words)

    def words(self, docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
        """(keys, word): stemmed words, before n-grams."""
        words = self.kept_words(docs, *keys, text=text)
        if self.vocabulary_stemmer is not None:
            return stem_by_vocabulary(words, self.vocabulary_stemmer)
        stemmed = self.stem(F.col("word"))
        if self.mode == "bytes":
            stemmed = bytemode.to_byte_form(stemmed)
        return words.withColumn("word", stemmed)

    def counted_words(
        self,
        docs: DataFrame,
        *keys: str,
        text: str = "text",
        deal: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """(keys, word, tf): how often each stemmed word occurs by ``keys``, before n-grams.

        With a vocabulary stemmer the words are counted before the stems are joined, and
        stored, so the texts are read once and only different words are shuffled; ``deal``
        distributes the joined rows as the caller goes on with them.
        """
        count = F.count(F.lit(1)).alias("tf")
        if self.vocabulary_stemmer is None:
            return self.words(docs, *keys, text=text).groupBy(*keys, "word").agg(count)
        kept = self.kept_words(docs, *keys, text=text).groupBy(*keys, "word").agg(count)
        stemmed = stem_by_vocabulary(stored(kept, "words"), self.vocabulary_stemmer)
        stemmed = deal(stemmed) if deal else stemmed
        return stemmed.groupBy(*keys, "word").agg(F.sum("tf").alias("tf"))

    def tokens(self, docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
        """(keys, token): every occurrence of every index token."""
        return tx.gram_rows(
            self.words(docs, *keys, text=text), "word", "token", self.gram_sizes
        )

    def counted_tokens(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(token, n): how often each index token occurs in all texts.

        Words are counted and stored before their n-grams are made, so a word is cut once,
        and a task holds the tokens of a bounded number of different words.
        """
        words = stored(self.counted_words(docs, text=text), "counted")
        dealt = words.repartition(spread_width(words))
        rows = tx.gram_rows(dealt, "word", "token", self.gram_sizes)
        return rows.groupBy("token").agg(F.sum("tf").alias("n"))

    def has_tokens(self, text: Column) -> Column:
        """True when the text yields at least one token.

        Any symbol or digit is a token of its own, so most texts are settled by
        the first such character; only the others are tokenised.
        """
        if isinstance(self.stopwords, DataFrame):
            raise ValueError("a stopword table needs the row form")
        stop = tx.literals(self.stopwords)
        words = self.tokenize(self._prepared(text))
        if stop:
            kept = F.exists(words, lambda t: ~self.normalize(t).isin(stop))
        else:
            kept = F.size(words) > 0
        if (
            self.tokenizer is None
            and self.mode == "unicode"
            and _only_letters(self.stopwords)
        ):
            kept = F.when(text.rlike(rf"[^{tx.SPACE_CLASS}\p{{L}}]"), F.lit(True)).otherwise(
                kept
            )
        return F.coalesce(kept, F.lit(False))

    # -- helpers -----------------------------------------------------------
    def _prepared(self, text: Column) -> Column:
        if self.mode == "unicode" and self.tokenizer is None:
            return F.replace(text, F.lit("ß"), F.lit("ẞ"))
        return text

    def _without_stopwords(self, words: DataFrame) -> DataFrame:
        if isinstance(self.stopwords, DataFrame):
            listed = self.stopwords.select("word").distinct()
            return join_lookup(words, listed, ["word"], how="left_anti")
        stop = list(self.stopwords)
        return words.where(~tx.in_list("word", stop)) if stop else words


def _only_letters(stopwords: Sequence[str]) -> bool:
    """No stopword could be a symbol, number or empty token."""
    return all(any(ch.isalpha() for ch in word) for word in stopwords)


def stem_by_vocabulary(
    words: DataFrame, stemmer: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Replace ``word`` by its lower-case stem from a table over the distinct words.

    The stems are written to the shared folder first: the long projection runs
    once per distinct word, and the join sees a plain table whose size can be
    checked from its footers.  Symbols and numbers, the hottest keys, never
    change; they get a null key so that no task collects them.
    """
    spark = words.sparkSession
    words = words.withColumn("word", F.lower("word"))
    letters = F.col("word").rlike(r"\p{L}")
    path = new_folder(spark, "stems")
    stemmer(words.select("word").where(letters).distinct()).write.parquet(path)
    changed = (
        spark.read.parquet(path)
        .where(F.col("stem") != F.col("word"))
        .select(F.col("word").alias("_key"), F.col("stem").alias("_stem"))
    )
    keyed = words.withColumn("_key", F.when(letters, F.col("word")))
    joined = join_lookup(keyed, changed, ["_key"], how="left")
    return joined.withColumn("word", F.coalesce("_stem", "word")).drop("_key", "_stem")
