import hashlib
import random

import numpy as np
from samples import ODD, SF, docs, no_docs, odd_docs  # noqa: F401

from textlode.llm import sketch
from textlode.llm.queries import op6_document_fingerprints


def parts(text, mean):
    """Paragraphs of a text, each with its number among equal ones."""
    data, found, seen = text.encode(), set(), {}
    start = 0
    for end in sketch.cuts(data, mean).tolist() if data else []:
        piece = data[start:end]
        seen[piece] = seen.get(piece, 0) + 1
        found.add((piece, seen[piece]))
        start = end
    return found


def alike(a, b):
    mean = sketch.fineness(max(len(a.encode()), len(b.encode())))
    a, b = parts(a, mean), parts(b, mean)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def expected(rows):
    out = []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first = next(t for i, t in rows if i is not None)
    for at, (i, text) in enumerate(rows):
        text, following = text or "", (rows[at + 1][1] if at + 1 < len(rows) else first) or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(text), digest, round(alike(text, edited), 9), round(alike(text, following), 9)))
    return out


def shown(rows):
    return [
        (r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))
        for r in rows
    ]


def test_peeling_recovers_the_difference():
    rng = random.Random(4)
    a = [rng.getrandbits(64) for _ in range(60)]
    b = a[:55] + [rng.getrandbits(64) for _ in range(3)]
    x, y = (
        sketch.sketch(np.array(k, np.uint64), np.array([len(k)]), 48, salt=1) for k in (a, b)
    )
    owner, key, sign, done = sketch.peel(x.minus(y))
    assert done.all() and not owner.any()
    assert set(key[sign == 1].tolist()) == set(a) - set(b)
    assert set(key[sign == -1].tolist()) == set(b) - set(a)
    assert not sketch.peel(sketch.sketch(np.array(a, np.uint64), np.array([60]), 18))[3].any()


def test_paragraphs_cover_the_text():
    for _, text in ODD:
        data = (text or "").encode()
        if data:
            fine = None
            for _, mean in sketch.PIECE_BYTES:
                ends = sketch.cuts(data, mean).tolist()
                assert ends[-1] == len(data) and ends == sorted(set(ends))
                assert fine is None or set(ends) <= fine
                fine = set(ends)


def test_one_character_less_changes_little_at_every_length(docs):
    texts = [r.text for r in docs.where("n_chars > 2200").orderBy("doc_id").limit(12).collect()]
    for text in texts:
        whole = text.encode().decode("ascii", "ignore")
        versions = sketch._Texts([whole[:n] for n in range(200, 2102)])
        n = len(versions.data)
        near, _ = sketch.alike(versions.span(1, n), versions.span(0, n - 1))
        assert near.min() > 0.9 and np.quantile(near, 0.02) > 0.95 and near.mean() > 0.97
        for bound, _ in sketch.PIECE_BYTES[1:]:
            assert near[bound - 201] > 0.95  # n = bound against n = bound - 1


def test_query_equals_sets_of_paragraphs(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = op6_document_fingerprints(spark, SF).collect()
    assert sorted(shown(got)) == expected(rows)
    prints = {r.doc_id: r.fingerprint for r in got}
    text = dict(rows)
    for a in text:
        for b in text:
            if text[a] == text[b]:
                assert prints[a] == prints[b]
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
    assert np.mean([r.near_edited for r in got]) > 0.6
    assert np.mean([r.tries_edited == 1 for r in got]) > 0.5
    assert all(r.tries_next >= 1 for r in got)


def test_odd_texts(spark, odd_docs, no_docs):
    got = sketch.fingerprints(odd_docs).collect()
    assert sorted(shown(got), key=str) == sorted(expected(ODD), key=str)
    assert sketch.fingerprints(no_docs).collect() == []
    one = spark.createDataFrame([(5, "abcdefgh" * 50)], "doc_id long, text string")
    (row,) = sketch.fingerprints(one).collect()
    assert row.near_next == 1.0
    own = "abcdefgh" * 50
    assert row.edited_sha256 == hashlib.sha256((own[:300] + own[:100]).encode()).hexdigest()
    nameless = spark.createDataFrame([(None, "abc"), (None, "")], "doc_id long, text string")
    assert len(sketch.fingerprints(nameless).collect()) == 2
