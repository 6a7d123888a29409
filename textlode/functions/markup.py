"""Markup as data: events and character data of HTML and XML texts.

Two readings of a text:

lenient  every piece counts, HTML entities are decoded, void elements close
         themselves; nothing ends the text early.
strict   XML rules; the text ends silently before the first event that is not
         well formed (mismatched end tag, unknown entity, ...).

Both are array expressions over one regular-expression split, so extracting the
text of a page needs neither a shuffle nor Python.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlode.functions.text import literal_map

#: Declarations inside declarations are matched to this depth; XML's own grammar has two.
DECLARATION_DEPTH = 8


def _declaration(depth: int) -> str:
    """What stands in a declaration: brackets in pairs, quoted ones and comments apart."""
    inner = rf"|<{_declaration(depth - 1)}>" if depth else ""
    return rf"""(?:[^<>"']++|"[^"]*+"|'[^']*+'|<!--.*?-->{inner})*+"""


# The pieces of a markup text, in order of preference.
PIECE_PATTERN = (
    r"(?s)<!--.*?-->"
    r"|<!\[CDATA\[.*?\]\]>"
    r"|<\?.*?\?>"
    rf"|<!(?!--|\[CDATA\[){_declaration(DECLARATION_DEPTH)}>"
    r"""|<[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
    r"|<[^>]*>"
    r"|[^<]+"
)
REFERENCE_PATTERN = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"
XML_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}
VOID_ELEMENTS = (
    "area", "base", "basefont", "br", "col", "frame", "hr", "img", "input", "isindex",
    "link", "meta", "param",
)
NAME = r"[\p{L}_:][\p{L}\p{N}_:.\-]*"
# Well-formed pieces under XML rules.
REFERENCE = r"&(?:lt|gt|amp|apos|quot|#[0-9]+|#x[0-9a-fA-F]+);"
# Repetition is possessive: Java matches it in a loop, not by recursion.
STRICT_ATTRIBUTES = (
    rf"""(?:\s*{NAME}\s*=\s*(?:"(?:[^"<&]++|{REFERENCE})*+"|'(?:[^'<&]++|{REFERENCE})*+'))*+"""
)
STRICT_START = rf"^<{NAME}{STRICT_ATTRIBUTES}\s*/?>$"
STRICT_END = rf"^</{NAME}\s*>$"
STRICT_TEXT = rf"^(?:[^&]++|{REFERENCE})*+$"

EVENT = "struct<kind:string,name:string,value:string>"


def html_entities() -> dict[str, str]:
    """Name -> character of the HTML 4 entities, from Python's own table."""
    table = {name: chr(code) for name, code in name2codepoint.items()}
    return {**table, **XML_ENTITIES}


def pieces(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(PIECE_PATTERN), F.lit(0))


def decode_references(value: Column, entities: dict[str, str]) -> Column:
    """Replace character and entity references; unknown ones stay as written."""
    table = literal_map(entities)

    def one(part: Column) -> Column:
        body = F.substring(part, F.lit(2), F.char_length(part) - 2)
        number = F.when(
            F.substring(body, 2, 1).isin("x", "X"),
            F.conv(F.substring(body, F.lit(3), F.char_length(body)), 16, 10),
        ).otherwise(F.substring(body, F.lit(2), F.char_length(body)))
        code = number.try_cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (
            F.when(~part.rlike("^&.+;$"), part)
            .when(F.startswith(body, F.lit("#")), F.when(valid, char).otherwise(part))
            .otherwise(F.coalesce(F.try_element_at(table, body), part))
        )

    parts = F.regexp_extract_all(value, F.lit(REFERENCE_PATTERN), F.lit(0))
    decoded = F.array_join(F.transform(parts, one), "")
    return F.when(F.contains(value, F.lit("&")), decoded).otherwise(value)


def is_text(piece: Column) -> Column:
    return ~F.startswith(piece, F.lit("<")) | F.startswith(piece, F.lit("<![CDATA["))


def text_value(piece: Column, entities: dict[str, str]) -> Column:
    """Character data of a text piece: CDATA unwrapped, references decoded."""
    lines = F.regexp_replace(piece, "\r\n?", "\n")
    cdata = F.substring(lines, F.lit(10), F.char_length(lines) - 12)
    return F.when(F.startswith(piece, F.lit("<![CDATA[")), cdata).otherwise(
        decode_references(lines, entities)
    )


def _event(kind: str, name: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value")).cast(
        EVENT
    )


def piece_events(piece: Column, strict: bool = False) -> Column:
    """Events of one piece: two for an element that closes itself."""
    none = F.lit(None).cast("string")
    entities = XML_ENTITIES if strict else html_entities()
    inner = F.substring(piece, F.lit(3), F.char_length(piece) - 3)
    # A comment inside a declaration counts as a blank, a quoted one stays.
    before_comment = r"""((?:[^"'<]++|<(?!!--)|"[^"]*+"|'[^']*+')*+)"""
    inner = F.regexp_replace(inner, rf"(?s)\G{before_comment}<!--.*?-->", "$1 ")
    start_name = F.regexp_extract(piece, r"^<\s*([^\s/>]+)", 1)
    attributes = F.trim(F.regexp_extract(piece, r"(?s)^<\s*[^\s/>]+(.*?)/?>$", 1))
    start = _event("start", start_name, attributes)
    closes = F.endswith(piece, F.lit("/>"))
    if not strict:
        closes = closes | F.lower(start_name).isin(*VOID_ELEMENTS)
    return (
        F.when(is_text(piece), F.array(_event("chardata", none, text_value(piece, entities))))
        .when(
            F.startswith(piece, F.lit("<!--")),
            F.array(
                _event(
                    "comment", none, F.substring(piece, F.lit(5), F.char_length(piece) - 7)
                )
            ),
        )
        .when(
            F.startswith(piece, F.lit("<?")),
            F.array(
                _event(
                    "procinst",
                    F.regexp_extract(piece, r"^<\?([^\s?]*)", 1),
                    F.regexp_extract(piece, r"(?s)^<\?[^\s?]*\s*(.*)\?>$", 1),
                )
            ),
        )
        .when(F.startswith(piece, F.lit("<!")), F.array(_event("directive", none, inner)))
        .when(
            F.startswith(piece, F.lit("</")),
            F.array(_event("end", F.regexp_extract(piece, r"^</\s*([^\s>]*)", 1), none)),
        )
        .when(closes, F.array(start, _event("end", start_name, none)))
        .otherwise(F.array(start))
    )


def markup_events(markup: Column, strict: bool = False) -> Column:
    """Ordered array of events: start, end, chardata, comment, procinst, directive."""
    parts = well_formed_pieces(markup) if strict else pieces(markup)
    return F.flatten(F.transform(parts, lambda p: piece_events(p, strict)))


def chardata_text(markup: Column, strict: bool = False) -> Column:
    """All character data in order, one blank after each run."""
    parts = well_formed_pieces(markup) if strict else pieces(markup)
    entities = XML_ENTITIES if strict else html_entities()
    runs = F.transform(F.filter(parts, is_text), lambda p: text_value(p, entities))
    return F.array_join(F.transform(runs, lambda r: F.concat(r, F.lit(" "))), "")


def well_formed_piece(piece: Column) -> Column:
    """Whether one piece obeys XML rules, nesting aside."""
    return (
        F.when(F.startswith(piece, F.lit("<![CDATA[")), F.lit(True))
        .when(
            F.startswith(piece, F.lit("<!--")),
            ~F.contains(F.substring(piece, F.lit(5), F.char_length(piece) - 7), F.lit("--"))
            & ~F.endswith(piece, F.lit("--->")),
        )
        .when(
            F.startswith(piece, F.lit("<?xml ")),
            ~piece.rlike(r"""encoding\s*=\s*["'](?!(?i:utf-8)["'])""")
            & ~piece.rlike(r"""version\s*=\s*["'](?!1\.0["'])"""),
        )
        .when(F.startswith(piece, F.lit("<?")), piece.rlike(rf"^<\?{NAME}"))
        .when(F.startswith(piece, F.lit("<!")), F.lit(True))
        .when(F.startswith(piece, F.lit("</")), piece.rlike(STRICT_END))
        .when(F.startswith(piece, F.lit("<")), piece.rlike(STRICT_START))
        .otherwise(piece.rlike(STRICT_TEXT) & ~F.contains(piece, F.lit("]]>")))
    )


def well_formed_pieces(markup: Column) -> Column:
    """The pieces before the first one that breaks XML rules.

    The fold keeps the names of the open elements and the position of the first
    offence; the text itself is cut once at the end.
    """
    parts = pieces(markup)
    state = "struct<open:array<string>,bad:int>"
    first = F.struct(
        F.array().cast("array<string>").alias("open"), F.lit(None).cast("int").alias("bad")
    ).cast(state)
    tagged = F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("at"),
            F.when(~well_formed_piece(p), "bad")
            .when(F.startswith(p, F.lit("</")), "end")
            .when(
                p.rlike(r"^<[^!?]") & ~F.endswith(p, F.lit("/>")),
                "start",
            )
            .otherwise("other")
            .alias("kind"),
            F.regexp_extract(p, rf"^</?({NAME})", 1).alias("name"),
        ),
    )

    def step(acc: Column, tag: Column) -> Column:
        depth = F.size(acc["open"])
        matches = (depth > 0) & (F.get(acc["open"], depth - 1) == tag["name"])
        is_end = tag["kind"] == "end"
        bad = (tag["kind"] == "bad") | (is_end & ~matches)
        return F.when(
            acc["bad"].isNotNull() | (tag["kind"] == "other"),
            acc,
        ).otherwise(
            F.struct(
                F.when(bad, acc["open"])
                .when(is_end, F.slice(acc["open"], F.lit(1), depth - 1))
                .otherwise(F.array_append(acc["open"], tag["name"]))
                .alias("open"),
                F.when(bad, tag["at"]).alias("bad"),
            ).cast(state)
        )

    cut = F.aggregate(tagged, first, step, lambda acc: acc["bad"])
    return F.slice(parts, F.lit(1), F.coalesce(cut, F.size(parts)))
