import brute
import pytest
from pyspark.sql import functions as F

from textlode import Analyzer
from textlode.functions import bytemode
from textlode.functions import text as tx
from textlode.functions.stopwords import load_stopwords


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("abc12,d", ["abc", "12", ",", "d"]),
        ("abc ", ["abc", ""]),
        ("abc", ["abc"]),
        ("", []),
        (" ", [""]),
        ("a b\u0085", ["a", "b", ""]),
        ("été 3½!", ["été", "3½", "!"]),
        ("a\x0bb", ["a", "b"]),
    ],
)
def test_tokenize(value, text, tokens):
    assert value(tx.tokenize, text) == tokens
    assert brute.raw_tokens(text) == tokens


@pytest.mark.parametrize(
    ("token", "stem"),
    [
        ("HAPPY", "HAPPi"),
        ("PLAY", "PLAi"),
        ("SKY", "SKi"),
        ("ZY", "ZY"),
        ("RUNNING", "RUNNING"),
        ("123", "123"),
        ("happy", "happy"),
    ],
)
def test_final_y(value, token, stem):
    assert value(tx.stem_final_y, token) == stem


@pytest.mark.parametrize(
    ("token", "grams"), [("RUST", ["RUS"]), ("CAT", []), ("HAPPi", ["HAP", "APP"]), ("", [])]
)
def test_ngrams(value, token, grams):
    assert value(lambda t: tx.ngrams(t, 3), token) == grams


def test_normalize_case(value):
    assert value(tx.normalize_case, " straße ") == "STRAẞE"


def test_stopwords():
    words = load_stopwords()
    assert len(words) == 636 and words[0] == "A" and words[-1] == "ZERO"
    assert "T" not in words


def test_missing_stopword_list(tmp_path):
    with pytest.raises(FileNotFoundError):
        load_stopwords(str(tmp_path / "none.txt"))
    own = tmp_path / "own.txt"
    own.write_text("ONE TWO\nTHREE")
    assert load_stopwords(str(own)) == ("ONE", "TWO", "THREE")


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("the can't", ["'", "T"]), ("Rust!", ["RUST", "RUS", "!"]), ("", []), ("the and", [])],
)
def test_analyze(value, text, tokens):
    assert value(Analyzer().analyze, text) == tokens


TEXTS = [
    "Happy players play happily; 42 skies.",
    "Étudiants, naïveté et straße 1½ ",
    "\tmixed white\u0085space\n",
    "O'Reilly can't won't",
    "",
    " ",
    "abcdefgh abcdefg abcdef abcde abcd abc",
]


def test_row_form_equals_array_form_and_model(spark, corpus):
    stop = set(load_stopwords())
    docs = corpus(TEXTS)
    an = Analyzer()
    arrays = {
        r.doc_id: r.t for r in docs.select("doc_id", an.analyze(F.col("text")).alias("t")).collect()
    }
    rows = {i: [] for i in range(len(TEXTS))}
    for r in an.tokens(docs, "doc_id").collect():
        rows[r.doc_id].append(r.token)
    for i, text in enumerate(TEXTS):
        assert sorted(rows[i]) == sorted(arrays[i])
        assert arrays[i] == brute.analyze(text.replace("ß", "ẞ"), stop)


def test_has_tokens(corpus):
    docs = corpus(["the", "rust", "", "the!", "the 1", "the ", "and the of"])
    found = docs.select("doc_id", Analyzer().has_tokens(F.col("text")).alias("h")).collect()
    assert [r.h for r in sorted(found)] == [False, True, False, True, True, True, False]


def test_stopword_table_and_empty_list(spark, corpus):
    docs = corpus(["red green blue", "red"])
    listed = spark.createDataFrame([("RED",), ("RED",)], "word string")
    kept = Analyzer(stopwords=listed).kept_words(docs, "doc_id").collect()
    assert sorted(r.word for r in kept) == ["BLUE", "GREEN"]
    every = Analyzer(stopwords=()).kept_words(corpus(["the a"]), "doc_id").collect()
    assert sorted(r.word for r in every) == ["A", "THE"]


def test_own_tokenizer_and_stemmer(corpus):
    an = Analyzer(
        tokenizer=lambda text: F.split(text, ","),
        stemmer=lambda token: F.substring(token, 1, 2),
        gram_sizes=(),
    )
    rows = an.tokens(corpus(["abc, def ,the"]), "doc_id").collect()
    assert sorted(r.token for r in rows) == ["AB", "DE"]


def test_unknown_mode():
    with pytest.raises(ValueError):
        Analyzer(mode="words")


def as_bytes(text):
    return text.encode("utf-8").decode("latin-1")


def byte_model(text, stopwords):
    """Tokens of the UTF-8 bytes, each byte read as a Latin-1 character."""
    out = []
    for token in brute.raw_tokens(as_bytes(text)):
        raw, fixed, i = token.encode("latin-1"), "", 0
        while i < len(raw):
            for width in (1, 2, 3, 4):
                try:
                    ch = raw[i : i + width].decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if len(ch) == 1:
                    fixed, i = fixed + ch, i + width
                    break
            else:
                fixed, i = fixed + "�", i + 1
        upper = fixed.upper()
        if upper in stopwords:
            continue
        if len(upper) >= 3 and upper.endswith("Y") and not upper.endswith("�Y"):
            upper = upper[:-1] + "i"
        upper = as_bytes(upper)
        out.append(upper)
        for n in (3, 5, 7):
            out.extend(upper[i : i + n] for i in range(len(upper) - n))
    return out


BYTE_TEXTS = ["café", "¼ cup", "tête fêté", "happy", "ª᪺ºé", "日本語 text", "éY aéy 𝒳y", "the é "]


def test_byte_mode(corpus):
    stop = set(load_stopwords())
    an = Analyzer(mode="bytes")
    docs = corpus(BYTE_TEXTS)
    rows = {i: [] for i in range(len(BYTE_TEXTS))}
    for r in an.tokens(docs, "doc_id").collect():
        rows[r.doc_id].append(r.token)
    arrays = docs.select("doc_id", an.analyze(F.col("text")).alias("t")).collect()
    for r in arrays:
        expected = byte_model(BYTE_TEXTS[r.doc_id], stop)
        assert r.t == expected
        assert sorted(rows[r.doc_id]) == sorted(expected)


def test_byte_tokens_read_back(value):
    tokens = value(lambda t: tx.tokenize(bytemode.to_byte_form(t)), "café ê")
    assert tokens == ["cafÃ", "©", "Ãª"]
    assert value(bytemode.readable, "cafÃ") == "caf�"
    assert value(bytemode.readable, "Ãª") == "ê"
    assert value(bytemode.readable, "\xe1\xaa") == "��"
