import zlib

import numpy as np
import pytest
from samples import SF, docs, no_docs, odd_docs  # noqa: F401

from textlode.llm import langid, quality
from textlode.llm.queries import (
    language_model,
    op4_language_id,
    op8_quality_classifier,
    quality_machine,
)

SF2 = "/root/testdata/sf0.01"


def plain_marginals(scores, transitions):
    """Marginals of one sequence by its paths' sums, in float64 logarithms."""
    n, k = scores.shape
    forward, backward = np.zeros((n, k)), np.zeros((n, k))
    forward[0] = scores[0]
    for t in range(1, n):
        forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + transitions, axis=0) + scores[t]
    for t in range(n - 2, -1, -1):
        backward[t] = np.logaddexp.reduce(transitions + scores[t + 1] + backward[t + 1], axis=1)
    total = forward + backward
    return np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])


def test_forward_backward():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 40, 7, 7])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    transitions = rng.normal(size=(3, 3))
    inner, pairs, logs = langid.marginals(scores, lengths, transitions)
    at = 0
    for n in lengths:
        want = plain_marginals(scores[at : at + n], transitions)
        assert np.allclose(inner[at : at + n], want)
        at += n
    assert np.isclose(pairs.sum(), (lengths - 1).sum())
    # The normaliser's slope by a transition is the expected number of its uses.
    step = 1e-5
    moved = transitions.copy()
    moved[0, 1] += step
    slope = (langid.marginals(scores, lengths, moved)[2].sum() - logs.sum()) / step
    assert np.isclose(slope, pairs[0, 1], atol=1e-3)


def test_windows_equal_whole_sequences(monkeypatch):
    rng = np.random.default_rng(2)
    lengths = np.array([5, 3000, 1, 900])
    scores = rng.normal(size=(lengths.sum(), 4)).astype(np.float32)
    transitions = np.eye(4) * 2.5 - 1.2
    whole = langid.expected(scores, lengths, transitions)
    monkeypatch.setattr(langid, "WINDOW", 100)
    monkeypatch.setattr(langid, "MARGIN", 120)
    assert np.allclose(langid.expected(scores, lengths, transitions), whole, atol=1e-5)


def test_code_switched_text():
    english = "the dog and the house with another thing that was there " * 4
    french = "le chien et la maison avec une autre chose qui est ici " * 4
    model = langid.fit([english, french], ["en", "fr"])
    names, scores = langid.label_texts(
        [english, french, english + french + french, "1 2 3", ""],
        model,
        langid.Memo(model.chunk_scores),
    )
    assert names == ["en", "fr", "fr", "und", "und"]
    assert 0.5 < scores[2] < 0.8 and scores[3] == scores[4] == 0


def test_long_runs_count_whole():
    for run in ("a" * 24, "ab" * 12 + "c", "abcdefg" * 700, "\u4f60\u597d" * 500):
        pieces = langid.letters_of(run)
        assert "".join(pieces) == run and max(map(len, pieces)) <= langid.WORD_CHARS
        assert langid.letters_of(f"1{run},x") == [*pieces, "x"]
    english = "the dog and the house with another thing that was there " * 4
    french = "le chien et la maison avec une autre chose qui est ici " * 4
    model = langid.fit([english, french], ["en", "fr"])
    joined = "".join(french.split())
    # French but for its first and last letters; and one run that outweighs English words.
    names, scores = langid.label_texts(
        ["thethingthat" + joined * 20 + "anotherthing", english + joined * 20],
        model,
        langid.Memo(model.chunk_scores),
    )
    assert names == ["fr", "fr"] and (scores > 0.6).all()


def test_op4_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = op4_language_id(spark, SF2).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_op4_learns_from_no_held_out_rows(spark, docs):
    from pyspark.sql import functions as F

    from textlode.llm.common import remainder

    changed = docs.withColumn(
        "lang", F.when(remainder("doc_id", 4) == 2, F.lit("xx")).otherwise(F.col("lang"))
    )
    assert "xx" not in language_model(changed).labels


def test_odd_texts(spark, odd_docs, no_docs, docs):
    model = language_model(docs)
    found = langid.predict(odd_docs, model, score="lang_score")
    for r in found.collect():
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == has_letter
        assert (r.lang_score > 0) == has_letter
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert {1, 2, 3, 6}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.predict(no_docs, model, score="s").count() == 0
    unlearned = langid.train(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, unlearned, score="s").collect()} == {"und"}


def pairs_by_hand(machine, x, n):
    """Margins with a sum over all pairs of features."""
    dense, out = machine.dense(x.dense), []
    for i in range(n):
        rows = x.row == i
        v = np.concatenate(
            [machine.factors[x.column[rows]] * x.value[rows][:, None],
             machine.factors[quality.BUCKETS :] * dense[i][:, None]]
        )
        linear = (machine.linear[x.column[rows]] * x.value[rows]).sum()
        linear += (machine.linear[quality.BUCKETS :] * dense[i]).sum()
        crossed = sum(v[a] @ v[b] for a in range(len(v)) for b in range(a))
        out.append(machine.bias + linear + crossed)
    return np.array(out)


def test_sum_of_squares_identity():
    texts = ["a b c a", "d", "", "one two\nthree"]
    machine = quality.fit(texts, [7, 1, 0, None], [1, 0, 1, 0], steps=3)
    x = quality.features(texts, [7, 1, 0, None], quality.Memo(quality.word_buckets))
    assert np.allclose(machine.sums(x)[0], pairs_by_hand(machine, x, len(texts)))


def test_op8_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    rows = op8_quality_classifier(spark, SF2).collect()
    assert len(rows) == spark.read.parquet(f"{SF2}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = [r.score for r in held if labels[r.doc_id]]
    bad = [r.score for r in held if not labels[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r.predicted for r in held if labels[r.doc_id]]) > 0.97


@pytest.mark.parametrize("labels", [[], [1, 1], [0]])
def test_one_label(labels):
    machine = quality.fit(["a"] * len(labels), [1] * len(labels), labels)
    x = quality.features(["some text", ""], [9, 0], quality.Memo(quality.word_buckets))
    assert set(machine.scores(x)) == {float(labels[0]) if labels else 0.5}


def test_quality_of_odd_texts(spark, odd_docs, no_docs, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = quality_machine(docs, labels)
    rows = quality.score(odd_docs, machine, name="q").collect()
    assert all(0 <= r.q <= 1 for r in rows) and len(rows) == odd_docs.count()
    kept = quality.keep_good(odd_docs, machine)
    assert kept.columns == odd_docs.columns
    assert quality.score(no_docs, machine, name="q").count() == 0
    assert quality_machine(no_docs, labels).constant == 0.5
    extra = labels.union(spark.createDataFrame([(None, 1, 1), (0, None, 1)], labels.schema))
    assert quality_machine(docs, extra).constant is None


@pytest.mark.parametrize("module", [langid, quality])
def test_texts_are_worked_on_in_small_parts(module, monkeypatch):
    """A batch of many texts is never split into words whole; a text is never cut."""
    held = []
    learn = langid.Memo.learn

    def noted(memo, *words):
        held.append(sum(map(len, words)))
        learn(memo, *words)

    monkeypatch.setattr(langid.Memo, "learn", noted)
    texts = ["ab cd " * 25_000] * 20 + ["ef " * 400_000]
    if module is langid:
        model = langid.fit(["ab cd", "ef gh"], ["x", "y"])
        names, _ = langid.label_texts(texts, model, langid.Memo(model.chunk_scores))
        assert names == ["x"] * 20 + ["y"]
    else:
        for a, b in quality.slices(texts):
            quality.features(texts[a:b], [None] * (b - a), langid.Memo(quality.word_buckets))
    assert sum(held) == 20 * 50_000 + 400_000 and max(held) <= 700_000
