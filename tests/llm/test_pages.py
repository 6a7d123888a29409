import base64
import time
import hashlib
import html
import io
import random
import re

import numpy as np
import pytest
from samples import SF  # noqa: F401

from textlode.llm import html_text, warc
from textlode.llm.queries import op1_html_extraction, op2_warc

ARTICLE = """<body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice"><p>We use cookies on this page to make it better for you.</p></div>
<div class="wrap"><div class="content"><h1>Title &amp; more</h1>
<p>Some   text with <a href=x>a link</a>
here<br>and <b>more</b>. <span class="ad">Buy now!</span>The end.</p><p>Ok.</p>
<ul><li>one<li>two</ul></div>
<div class="sidebar">A side note that is long enough to look like main text to some.</div></div>
<section id="comments"><article class="comment"><p>Nice post, I liked it a lot.</p></article></section>
<form><p>Your e-mail</p><input></form><footer>&copy; Site</footer></body>"""


def test_main_text_of_a_page_without_article():
    want = "Title & more\nSome text with a link here and more. The end.\nOk.\none\ntwo"
    assert html_text.main_text(ARTICLE) == want


def test_main_text_of_a_marked_article():
    page = """<nav><ul><li><a href=1>Home</a></ul></nav><main><article><h1>A</h1><p>b
    <p>c<script>var t="</p>";</script><aside>Read this too</aside><p>d &lt;e&gt; &amp</article></main>
    <div>A very long paragraph outside of the article that would win by its length alone.</div>"""
    assert html_text.main_text(page) == "A\nb\nc\nd <e> &"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>", ""),
        ("<div>a &#x41; &eacute;</div><!-- c --><style>x</style>", "a A é"),
        ("<nav>menu", ""),
        ("</p></div>odd<div", "odd"),
        ("<div hidden>no</div><p aria-hidden=true>no</p><p>yes</p>", "yes"),
    ],
)
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


def test_menus_go_without_an_article():
    page = """<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>
    <div><p>A long paragraph of main text that goes on for a while and then some more.</p>
    <p>Short.</p><p>Another long paragraph of main text that goes on for a while.</p></div>"""
    assert html_text.main_text(page).split("\n")[1] == "Short."
    assert "Home" not in html_text.main_text(page)


def test_smoothing_keeps_a_constant():
    assert np.allclose(html_text.smooth(np.full(9, 3.0)), 3.0)
    assert html_text.smooth(np.array([0, 0, 9.0, 0, 0])).argmax() == 2


def test_query_finds_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op1_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [
            " ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split())
            for b in re.split("</?(?:p|h1)>", article)
        ]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<p>" + "text & more " * 200
    rows = [
        (1, "http://a", None), (2, None, ""), (3, "http://c", big), (4, "u", big), (4, "u", big),
        (5, "http://\n e", "<p>é\U0001f600" * 300), (None, "n", big), (6, "f", "x" * 3_000_000),
        (7, "g", "small"), (8, "h", "small"), (9, "i", "WARC/1.1\r\nWARC/1.1\r\n" * 100),
    ]
    rows = [(*r, "response", 1, "d") for r in rows]
    return spark.createDataFrame(
        rows, "page_id long, url string, html string, record_type string, refers_to long, text string"
    )


def plain_archive(rows):
    """Expected rows of op2."""
    newest = {}
    for i, html_ in rows:
        data = (html_ or "").encode()
        if len(data) >= 1000 and i is not None:
            newest[data] = max(i, newest.get(data, i))
    out = []
    for i, html_ in rows:
        data = (html_ or "").encode()
        kept = newest.get(data)
        revisit = i is not None and kept is not None and kept != i
        out.append(
            (i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
             kept if revisit else None)
        )
    return sorted(out, key=str)


def test_op2_round_trip(spark, odd_pages):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = plain_archive([(r.page_id, r.html) for r in pages.collect()])
    assert sorted(map(tuple, op2_warc(spark, SF).collect()), key=str) == want
    want = plain_archive([(r.page_id, r.html) for r in odd_pages.collect()])
    assert sorted(map(tuple, warc.archived(odd_pages).collect()), key=str) == want
    assert warc.archived(odd_pages.limit(0)).collect() == []
    assert html_text.page_texts(odd_pages.limit(0)).collect() == []
    assert len(html_text.page_texts(odd_pages).collect()) == odd_pages.count()


def test_files_are_split_and_hold_the_payloads(spark, tmp_path, odd_pages):
    marked = warc.mark_revisits(odd_pages)
    files = warc.write_archives(marked, str(tmp_path), file_bytes=1000)
    assert files.count() > 2
    rows = warc.read_archives(files).collect()
    assert sorted(r.page_id or 0 for r in rows) == sorted(r.page_id or 0 for r in odd_pages.collect())
    html_of = {r.page_id: r.html or "" for r in odd_pages.collect()}
    for r in rows:
        assert r.gap is None
        if r.record_type == "response":
            assert bytes(r.payload).decode() == html_of[r.page_id]


def archive(n, packed=True):
    rng = random.Random(n)
    records = [
        warc.record(i, f"http://x/{i}", bytes(rng.randrange(32, 127) for _ in range(rng.randrange(1500, 3000))))
        for i in range(n)
    ]
    return [warc.member(r) for r in records] if packed else records


def read(data):
    found = list(warc.salvage(io.BytesIO(data)))
    records = [int(r.head["x-page-id"]) for r in found if isinstance(r, warc.Record)]
    gaps = [(g.start, g.end) for g in found if isinstance(g, warc.Gap)]
    spans = [(f.start, f.end) for f in found]
    # Records and gaps cover the file without holes.
    assert [0, *(e for _, e in spans)] == [*(s for s, _ in spans), len(data)]
    return records, gaps


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "insert", "version", "tail"])
def test_salvage(packed, damage):
    parts = archive(12, packed)
    assert read(b"".join(parts)) == (list(range(12)), [])
    start = sum(map(len, parts[:5]))
    part = parts[5]
    middle = len(part) // 2
    lost = [5]
    if damage == "flip":
        parts[5] = part[:middle] + bytes([part[middle] ^ 0x55]) + part[middle + 1 :]
    elif damage == "cut":
        parts[5] = part[:middle]
    elif damage == "insert":
        parts[5] = b"\x1f\x8b\x08junk WARC/1.1\r\nnot a record\r\n\r\n" * 3 + part
        lost = []
    elif damage == "version":
        parts[5] = b"\x00" + part[1:]
    else:
        parts[-1] = parts[-1][:-6]
        lost, start = [11], sum(map(len, parts[:-1]))
    records, gaps = read(b"".join(parts))
    assert records == [i for i in range(12) if i not in lost]
    assert gaps and gaps[0][0] == start


def foreign(i, size=2000, padding=0, digest=None):
    """A record as crawlers write it: base32 digests, further head lines."""
    rng = random.Random(i)
    body = bytes(rng.randrange(32, 127) for _ in range(size))
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    b32 = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (block, body)]
    head = (
        f"WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: {i}\r\nX-Long: {'y' * padding}\r\n"
        f"WARC-Block-Digest: sha1:{digest or b32[0]}\r\nWARC-Payload-Digest: sha1:{b32[1]}\r\n"
        f"Content-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def test_foreign_records_are_sound():
    plain = [foreign(0), foreign(1, padding=100_000), foreign(2, padding=600_000), foreign(3, 400_000)]
    assert read(b"".join(plain)) == ([0, 1, 2, 3], [])
    assert read(b"".join(map(warc.member, plain))) == ([0, 1, 2, 3], [])
    wrong = foreign(4, digest="A" * 32)
    records, gaps = read(b"".join([plain[0], wrong, plain[1]]))
    assert records == [0, 1] and gaps == [(len(plain[0]), len(plain[0]) + len(wrong))]


def test_members_of_several_records():
    records = [foreign(i) for i in range(6)]
    packed = warc.member(b"".join(records[:4])) + warc.member(b"".join(records[4:]))
    found = list(warc.salvage(io.BytesIO(packed)))
    assert [int(r.head["x-page-id"]) for r in found] == list(range(6))
    assert found[-1].end == len(packed)
    wrong = warc.member(b"".join([records[0], foreign(9, digest="A" * 32), records[2]]))
    found = list(warc.salvage(io.BytesIO(wrong + warc.member(records[3]))))
    assert [type(f) is warc.Gap for f in found] == [False, False, True, False]
    assert [int(f.head["x-page-id"]) for f in found if type(f) is warc.Record] == [0, 2, 3]
    assert (found[2].start, found[2].end) == (0, len(wrong)) and "digest" in found[2].reason


def test_salvage_of_nothing():
    assert read(b"") == ([], [])
    assert read(b"no archive at all") == ([], [(0, 17)])


LONG = "A long paragraph of main text that goes on for a while and then some more. "


@pytest.mark.parametrize(
    "around",
    [
        '<article class="post comments-open">{}</article>',
        '<div class="layout has-sidebar"><main>{}</main></div>',
        '<div id="no-sidebar">{}</div>',
        '<div class="withSidebar">{}</div>',
        '<div class="sidebar"><main>{}</main></div>',
        '<div class="widget"><article>{}</article></div>',
        '<div class="page sidebar">{}</div>',
        '<div role="main" class="search">{}</div>',
        '<article class="legal">{}</article>',
    ],
)
def test_names_around_an_article_do_not_drop_it(around):
    article = f"<h1>Title</h1><p>{LONG * 3}</p><p class='legal'>Of law.</p><p class='social-science'>Of man.</p>"
    article += "<div class='search-result'>Found.</div><div class='ad'>Buy!</div>"
    page = "<body><div>Site</div>" + around.format(article) + "<div class='sidebar'>Side note.</div>"
    text = html_text.main_text(page)
    for part in ("Title", (LONG * 3).strip(), "Of law.", "Of man.", "Found."):
        assert part in text.split("\n")
    assert "Buy!" not in text and "Side note." not in text


def test_other_texts_do_not_win_by_their_length():
    page = f"<div class=text><h1>T</h1><p>{LONG}</p></div><div id=comments><p>{LONG * 3}</p></div>"
    assert html_text.main_text(page) == f"T\n{LONG.strip()}"
    page = f"<div class=text><p>{LONG}</p></div><div class=related><article>Read on.</article></div>"
    assert html_text.main_text(page) == LONG.strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (
            f"<div><h1>T</h1><p>{'a' * 100}</p><blockquote><p>{'b' * 1000}</p></blockquote></div>",
            f"T\n{'a' * 100}\n{'b' * 1000}",
        ),
        (
            f"<div><h1>T</h1><p>{'a' * 200}</p><section><p>{'b' * 1000}</p></section><p>End.</p></div>",
            f"T\n{'a' * 200}\n{'b' * 1000}\nEnd.",
        ),
        (
            f"<table><tr><td><p>{'a' * 150}</p></td><td><p>{'b' * 1000}</p></td></tr></table>",
            f"{'a' * 150}\n{'b' * 1000}",
        ),
        (
            f"<div><h1><a href=x>Title</a></h1><p><a href=y>One link.</a></p><p>{'a' * 300}</p>"
            "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div>",
            f"Title\nOne link.\n{'a' * 300}",
        ),
        (
            f"<article><h1>S</h1><p>o</p><p>r</p><p>t</p></article>{'<br>' * 9}"
            f"<p></p><p></p><p></p><div>a</div><div>b</div><div>c</div><div>{'d' * 1000}</div>",
            "S\no\nr\nt",
        ),
    ],
)
def test_the_region_holds_the_whole_article(page, text):
    assert html_text.main_text(page) == text


BODY = "<p>" + "word " * 80 + "</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>hello</p><![foo[ bar ]]><p>x</p>", "hello\nx"),
        ("<p>a</p><![ foo <p>b", "a\nb"),
        (f"<form id='aspnetForm'><article>{BODY}</article></form>", ("word " * 80).strip()),
        (f"<form>{BODY}</form>", ("word " * 80).strip()),
        (f"<nav><a href=x>Home</a><article>{BODY}</article>", ("word " * 80).strip()),
        (f"<button><article>{BODY}</article>", ("word " * 80).strip()),
        (f"<div style='visibility:hidden'>{BODY}</div>", ("word " * 80).strip()),
        (f"<article>{BODY}</article><aside>{BODY}</aside><footer>x y</footer>", ("word " * 80).strip()),
        ("<p>a <b and c < d", "a"),
    ],
)
def test_malformed_and_wrapped_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "page",
    ["<a " * 340_000, "<div>" * 20_000 + "x", "<div>x " * 20_000, "<b>" * 20_000 + "<p>x" * 20_000,
     "<p>x</q>" * 20_000],
)
def test_time_does_not_grow_with_the_square(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 8


def test_marks_renamed_give_the_same_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for page in pages:
        plain = re.sub("<(/?)(article|main)\\b", r"<\1div", page.html)
        assert html_text.main_text(plain) == html_text.main_text(page.html)
