import pytest
from test_mixing import plain_count
from test_simhash import plain_components

import corpus_pipeline
from samples import SF, docs, no_docs, odd_docs  # noqa: F401

from textlode.llm import bpe, langid, mixing, quality
from textlode.llm.queries import TOKENIZER, language_model, quality_machine

TABLE = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_equals_its_steps(spark, docs):
    """Each stage's decisions, made again row by row from the operators' outputs."""
    rows = [r for r in docs.collect()]
    model = language_model(docs)
    names, scores = langid.label_texts([r.text for r in rows], model, langid.Memo(model.chunk_scores))
    rows = [r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= langid.LEAST]
    kept = spark.createDataFrame(rows, docs.schema)
    machine = quality_machine(kept, spark.read.parquet(f"{SF}/labels.parquet"))
    x = quality.features(
        [r.text for r in rows], [r.n_chars for r in rows], quality.Memo(quality.word_buckets)
    )
    rows = [r for r, s in zip(rows, machine.scores(x), strict=True) if s >= quality.THRESHOLD]
    first = {i: c for i, _, c in plain_components([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if first[r.doc_id] == r.doc_id]
    mass = {}
    for r in rows:
        mass[r.source] = mass.get(r.source, 0) + len(r.text) + 1
    weight = {s: m**mixing.POWER for s, m in mass.items()}
    total, all_weight = sum(mass.values()), sum(weight.values())
    codec, want = bpe.codec(TOKENIZER), []
    for r in rows:
        rate = weight[r.source] / all_weight * total / mass[r.source]
        ids = codec.encode(r.text).tolist()
        row = (r.doc_id, r.source, r.lang, len(ids), tuple(ids))
        want += [row] * plain_count(rate, r.doc_id)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "source", "lang", "n_tokens", "ids"]
    assert sorted((*r[:4], tuple(r.ids)) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_and_no_documents(spark, odd_docs, no_docs, empty):
    docs = no_docs if empty else odd_docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
        n = made.count()
        assert n == 0 if empty else n >= 0


def test_contract():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.ORACLE_SQL is None
