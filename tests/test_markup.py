import pytest
from pyspark.sql import functions as F

from textlode.functions import markup


def text_of(value, html, strict=False):
    return value(lambda c: markup.chardata_text(c, strict), html)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<a>x<!--c--><b>y</b></a>", "x y "),
        ("<p>a &amp; b &lt;&#65;&#x42;&#128512;&eacute;&nope;</p>", "a & b <AB😀é&nope; "),
        ("a<![CDATA[<b> & ]]>c", "a <b> &  c "),
        ('<a title="x > y">t</a>', "t "),
        ("<?pi x?><!DOCTYPE html>t", "t "),
        ("line\r\nend\rx", "line\nend\nx "),
        ("", ""),
        ("<b></b>", ""),
    ],
)
def test_lenient_text(value, html, text):
    assert text_of(value, html) == text


@pytest.mark.parametrize(
    ("xml", "text"),
    [
        ("<a>x<b>y</a>z", "x y "),
        ("<a>x</a>y", "x y "),
        ("<a>x<br/>y</a>", "x y "),
        ("<a>x</b>", "x "),
        ("x</a>y", "x "),
        ("<a>one<b>two&nbsp;</b></a>", "one "),
        ("<a>one &amp; two<b>a & b</b></a>", "one & two "),
        ("<a>x<b c=d>y</b></a>", "x "),
        ("<a>x<b c='d'>y</b></a>", "x y "),
        ("<a>x<b hidden>y</b></a>", "x "),
        ("<a>x<!-- a -- b -->y</a>", "x "),
        ("<a>x<!-- a - b -->y</a>", "x y "),
        ("<a>x]]>y</a>", ""),
        ("<?xml version='1.0' encoding='UTF-8'?><a>x</a>", "x "),
        ("<?xml version='1.0' encoding='latin1'?><a>x</a>", ""),
        ("<html><meta charset=\"u\"><title>t</title></head>z", "t "),
    ],
)
def test_strict_prefix(value, xml, text):
    assert text_of(value, xml, strict=True) == text


def test_events(spark):
    html = '<!DOCTYPE x><a href="u">t<br><img src="i"/></a><!-- c --><?go run?>'
    page = spark.createDataFrame([(html,)], "html string")
    events = page.select(F.inline(markup.markup_events(F.col("html")))).collect()
    assert [tuple(e) for e in events] == [
        ("directive", None, "DOCTYPE x"),
        ("start", "a", 'href="u"'),
        ("chardata", None, "t"),
        ("start", "br", ""),
        ("end", "br", None),
        ("start", "img", 'src="i"'),
        ("end", "img", None),
        ("end", "a", None),
        ("comment", None, " c "),
        ("procinst", "go", "run"),
    ]


def test_strict_events_do_not_close_void_elements(spark):
    page = spark.createDataFrame([("<a><br>x</br></a>",)], "html string")
    kinds = page.select(F.inline(markup.markup_events(F.col("html"), True))).collect()
    assert [e.kind for e in kinds] == ["start", "start", "chardata", "end", "end"]


def test_long_texts_do_not_recurse(value):
    long_text = "<a>" + "word &amp; " * 20000 + "</a>"
    assert text_of(value, long_text, strict=True) == "word & " * 20000 + " "
    many = "<a " + " ".join(f"k{i}='v'" for i in range(3000)) + ">x</a>"
    assert text_of(value, many, strict=True) == "x "
    assert text_of(value, many) == "x "


DECLARED = (
    '<!DOCTYPE r [<!ENTITY a "b">]>',
    '<!DOCTYPE r [<!ENTITY a "x > y"><!ELEMENT r (#PCDATA)>]>',
    "<!DOCTYPE r [<!-- it's > \" one --><!ENTITY % p '<!ENTITY q \"z\">'> %p;]>",
    "<!DOCTYPE r [<!ATTLIST r <a <b>> >]>",
    "<!DOCTYPE r SYSTEM 'a>b' [\n<?pi x?>\n<!NOTATION n PUBLIC \"->\">\n]>",
)


@pytest.mark.parametrize("declared", DECLARED)
def test_declarations_hold_declarations(value, declared):
    assert text_of(value, declared + "<r>t</r>") == "t "
    assert text_of(value, declared + "<r>t</r>", strict=True) == "t "


def test_declaration_value(value):
    events = value(markup.markup_events, '<!DOCTYPE r [<!-- c > --><!ENTITY a "<!-- -->"><!--"-->]>t')
    assert [tuple(e) for e in events] == [
        ("directive", None, 'DOCTYPE r [ <!ENTITY a "<!-- -->"> ]'),
        ("chardata", None, "t"),
    ]


def test_unpaired_declarations_end_at_their_first_bracket(value):
    assert text_of(value, "<!DOCTYPE r [<!ENTITY a>t") == "t "
    assert text_of(value, "<!DOCTYPE r><b>t</b>") == "t "
    assert text_of(value, "<! " * 2000 + "t>u") == "u "


def test_long_declarations(value):
    many = "<!DOCTYPE r [" + '<!ENTITY e "v">\n' * 20_000 + "]>t"
    assert text_of(value, many) == "t "
