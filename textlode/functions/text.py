"""Text scalars: tokenise, normalise, stem and slice, all JVM-side.

``tokenize``, ``normalize_case`` and ``stem_final_y`` work on whole columns and
stay inside code generation.  ``gram_rows`` is the row form of the n-gram step:
it explodes a plain integer sequence and cuts each gram with ``substring``, so
no lambda runs per character.  ``with_ngrams`` is the array form for callers
that need one array per text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They decide which tokens exist, so results depend on them.
GRAM_SIZES = (3, 5, 7)
SPACE_CLASS = r"\s\x{85}\x{A0}"
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\s\x{85}\x{A0}\p{L}\p{N}]"


def tokenize(text: Column) -> Column:
    """Letter runs, number runs and single symbols, in order.

    White space separates tokens.  Text that ends in white space yields one
    more, empty, token.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.when(ends_in_space(text), F.concat(tokens, F.array(F.lit("")))).otherwise(
        tokens
    )


def ends_in_space(text: Column) -> Column:
    return F.substring(text, -1, 1).rlike(f"[{SPACE_CLASS}]")


def normalize_case(token: Column) -> Column:
    """Upper case without surrounding blanks; a sharp s keeps its length."""
    return F.trim(F.upper(F.replace(token, F.lit("ß"), F.lit("ẞ"))))


def sql_strings(values: Sequence[str]) -> str:
    """Values as a list of SQL literals."""
    escaped = (v.replace("\\", "\\\\").replace("'", "\\'") for v in values)
    return ", ".join(f"'{v}'" for v in escaped)


def in_list(column: str, values: Sequence[str]) -> Column:
    """Column IN (values), parsed by Spark in one call; planned as a hash set."""
    return F.expr(f"`{column}` IN ({sql_strings(values)})") if values else F.lit(False)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.expr(f"map({sql_strings([x for pair in pairs.items() for x in pair])})")


def remove_stopwords(tokens: Column, stopwords: Sequence[str]) -> Column:
    """Array form of the stopword filter."""
    words = literals(stopwords)
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def literals(values: Sequence[str]) -> list[Column]:
    """Values as literal columns, built once per session."""
    return _literals(tuple(values), SparkContext.getOrCreate().applicationId)


@lru_cache(maxsize=8)
def _literals(values: tuple[str, ...], application: str) -> list[Column]:
    return [F.lit(v) for v in values]


def stem_final_y(token: Column) -> Column:
    """Effective stem of an upper-case token: a final Y becomes a small i.

    Tokens under three characters stay as they are.
    """
    applies = F.endswith(token, F.lit("Y")) & (F.char_length(token) >= 3)
    cut = F.substring(token, F.lit(1), F.char_length(token) - 1)
    return F.when(applies, F.concat(cut, F.lit("i"))).otherwise(token)


def ngrams(token: Column, n: int) -> Column:
    """Substrings of length ``n``, the last one left out."""
    length = F.char_length(token)
    cut = F.transform(
        F.sequence(F.lit(1), length - n), lambda i: F.substring(token, i, F.lit(n))
    )
    return F.when(length > n, cut).otherwise(F.array().cast("array<string>"))


def with_ngrams(token: Column, sizes: Sequence[int] = GRAM_SIZES) -> Column:
    """The token followed by its n-grams of every size."""
    return F.concat(F.array(token), *(ngrams(token, n) for n in sizes))


def gram_rows(
    words: DataFrame, word: str = "word", out: str = "token", sizes: Sequence[int] = GRAM_SIZES
) -> DataFrame:
    """Row form of ``with_ngrams``: one row per token, ``word`` dropped.

    Every word becomes ``1 + sum(max(len - n, 0))`` rows.  The row number tells
    size and start of its gram, so the cut is one ``substring`` call.
    """
    rows = words.withColumn("_length", F.char_length(F.col(word)))
    counts = [F.greatest(F.col("_length") - n, F.lit(0)) for n in sizes]
    total = F.lit(0)
    for count in counts:
        total = total + count
    rows = rows.withColumn("_row", F.explode(F.sequence(F.lit(0), total)))
    token = F.when(F.col("_row") == 0, F.col(word))
    before = F.lit(0)
    for n, count in zip(sizes, counts):
        start = F.col("_row") - before
        token = token.when(
            F.col("_row") <= before + count, F.substring(F.col(word), start, F.lit(n))
        )
        before = before + count
    return rows.withColumn(out, token).drop("_length", "_row", word)
