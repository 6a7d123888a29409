import numpy as np
import pytest

from textlode.llm import ann
from textlode.llm.queries import op10_nearest_neighbours

SF = "/root/testdata/sf0.1"


def exact(ids, vectors, queries, n=5):
    """(query, [(score, id), ...]) over all rows by brute force."""
    x = np.array(vectors, np.float64)
    norms = np.linalg.norm(x, axis=1)
    out = {}
    for q in queries:
        at = ids.index(q)
        scores = x @ x[at] / (norms * norms[at])
        rows = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)
        out[q] = [(-s, i) for s, i in rows[:n]]
    return out


def found_of(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = [r.vec_id for r in rows]
    want = exact(ids, [r.embedding for r in rows], [i for i in ids if i % 50 == 0])
    got = found_of(op10_nearest_neighbours(spark, SF))
    assert got.keys() == want.keys()
    hits = [i in {j for _, j in got[q]} for q in want for _, i in want[q]]
    assert np.mean(hits) >= 0.9
    place = {i: k for k, i in enumerate(ids)}
    for q, found in got.items():
        assert len(found) == 5 and found == sorted(found, key=lambda r: (-r[0], r[1]))
        for score, i in found:
            a, b = (np.array(rows[place[x]].embedding) for x in (q, i))
            assert abs(score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_probes_are_ordered_by_distance_to_boundaries():
    at = np.array([[0.1, 0.5, 0.9, 0.45]])
    found = ann.probes(at)[0]
    assert found[0] == ann.codes(np.floor(at))[0]
    assert found[1] in {ann.codes(np.array([-1, 0, 0, 0])), ann.codes(np.array([0, 0, 1, 0]))}
    assert len(set(found.tolist())) == ann.PROBES


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (50, [0.0, 2.0, 0.0]), (100, None), (150, [0.0, 0.0, 0.0]),
        (200, [1.0, None, 0.0]), (250, [nan, 1.0, 0.0]), (300, [inf, 1.0, 0.0]), (350, []),
        (400, [1.0, 0.0]), (401, [1.0, 1.0]), (None, [1.0, 0.0, 0.0]),
        (450, [1e200, 1e200, 0.0]), (451, [1e-200, 1e-200, 0.0]),
        *((i, [1.0, 0.0, 0.0]) for i in range(1, 10)), (50, [0.0, 2.0, 0.0]),
    ]
    return spark.createDataFrame(
        [(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double"
    )


def test_odd_vectors(odd_vectors):
    got = found_of(ann.nearest(odd_vectors, odd_vectors.where("vec_id % 50 = 0")))
    assert got.keys() == {0, 50, 400, 450}
    assert [i for _, i in got[0]] == [1, 2, 3, 4, 5] and {s for s, _ in got[0]} == {1.0}
    assert got[400] == [(pytest.approx(0.5**0.5), 401)]
    assert got[450][0] == (pytest.approx(1.0), 451)
    assert len(got[50]) == 5 and 50 not in {i for _, i in got[50]}
    nothing = odd_vectors.limit(0)
    assert ann.nearest(nothing, nothing).collect() == []
    assert ann.nearest(odd_vectors, nothing).collect() == []


def test_many_different_vectors_tie(spark):
    rng = np.random.default_rng(7)
    for trial in range(3):
        base = rng.normal(size=6)
        order = rng.permutation(np.arange(1, 61)).tolist()
        # Powers of two scale without rounding, so the cosines are equal to the last bit.
        rows = [(0, base.tolist())] + [(i, (base * 2.0**k).tolist()) for k, i in enumerate(order, -30)]
        rows += [(i, rng.normal(size=6).tolist()) for i in range(100, 160)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = found_of(ann.nearest(df, df.where("vec_id = 0")))
        assert [i for _, i in got[0]] == [1, 2, 3, 4, 5], trial


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 2000, 2)]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(1, 400, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, vectors = zip(*rows, strict=True)
    queries = [0, 50, 100, 1950]
    got = found_of(ann.nearest(df, df.where("vec_id in (0, 50, 100, 1950)")))
    want = exact(list(ids), vectors, queries)
    assert {q: [i for _, i in r] for q, r in got.items()} == {
        q: [i for _, i in r] for q, r in want.items()
    }
