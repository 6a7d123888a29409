"""Byte-wise analysis of text, for parity with byte-oriented indexes.

The *byte form* of a string has one character per UTF-8 byte (ISO-8859-1
reading of its bytes).  In byte mode tokens are cut on that form, so a
multi-byte letter may be split, and every token of the index is kept in byte
form, which loses nothing.  ``readable`` turns such a token back into text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Well-formed UTF-8 sequences and U+FFFD, written in byte form.
VALID_MULTIBYTE = (
    r"[\xC2-\xDF][\x80-\xBF]"
    r"|\xE0[\xA0-\xBF][\x80-\xBF]"
    r"|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}"
    r"|[\xF1-\xF3][\x80-\xBF]{3}"
    r"|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)
REPLACEMENT = "ï¿½"


def to_byte_form(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_byte_form(token: Column) -> Column:
    """Text of a byte-form token; each stray byte becomes one U+FFFD."""
    stray = rf"\G((?:[\x00-\x7F]|{VALID_MULTIBYTE})*+)[\x80-\xFF]"
    valid = F.regexp_replace(token, stray, "$1" + REPLACEMENT)
    text = F.decode(F.encode(valid, "ISO-8859-1"), "UTF-8")
    return F.when(token.rlike(r"[\x80-\xFF]"), text).otherwise(token)


readable = from_byte_form


def upper_byte_form(token: Column) -> Column:
    """Upper-cased text of a byte-form token (as text, not in byte form)."""
    return F.upper(from_byte_form(token))


def stem_final_y_bytes(token: Column) -> Column:
    """Final-Y stem; a Y right after U+FFFD stays."""
    applies = (
        F.endswith(token, F.lit("Y"))
        & ~F.endswith(token, F.lit("�Y"))
        & (F.char_length(token) >= 3)
    )
    cut = F.substring(token, F.lit(1), F.char_length(token) - 1)
    return F.when(applies, F.concat(cut, F.lit("i"))).otherwise(token)
