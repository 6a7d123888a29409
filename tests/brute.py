"""Plain-Python model of the search semantics, for small fixtures only."""

import math
from collections import Counter

import regex

SPACE = " \t\n\x0b\f\r\x85\xa0"
RUN = regex.compile(r"\p{L}+|\p{N}+|[^\s\x85\xa0\p{L}\p{N}]", regex.ASCII)


def raw_tokens(text):
    out, i = [], 0
    while i < len(text):
        ch = text[i]
        if ch in SPACE:
            i += 1
            continue
        end = i + 1
        for kind in (r"\p{N}", r"\p{L}"):
            if regex.match(kind, ch):
                while end < len(text) and regex.match(kind, text[end]):
                    end += 1
                break
        out.append(text[i:end])
        i = end
    if text and text[-1] in SPACE:
        out.append("")
    return out


def analyze(text, stopwords):
    out = []
    for token in raw_tokens(text):
        token = token.upper()
        if token in stopwords:
            continue
        if len(token) >= 3 and token.endswith("Y"):
            token = token[:-1] + "i"
        out.append(token)
        for n in (3, 5, 7):
            out.extend(token[i : i + n] for i in range(len(token) - n))
    return out


def search(texts, query, stopwords, mode):
    postings = {doc: Counter(analyze(text, stopwords)) for doc, text in texts.items()}
    df = Counter(token for counts in postings.values() for token in counts)
    wanted = set(analyze(query, stopwords))
    if mode == "float":
        n = len(texts)
        if any(token not in df for token in wanted):
            return {}
        idf = {t: math.log(n / df[t]) for t in wanted}
    else:
        n = sum(1 for counts in postings.values() if counts)
        idf = {t: math.log(n // df[t]) for t in wanted if t in df}
    scores = {
        doc: sum(counts[t] * w for t, w in idf.items()) for doc, counts in postings.items()
    }
    return {doc: round(score, 6) for doc, score in scores.items() if score > 0}
