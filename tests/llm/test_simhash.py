import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from samples import SF, docs, no_docs, odd_docs  # noqa: F401

import corpus_pipeline
from textlode.llm import simhash
from textlode.llm.components import components
from textlode.llm.queries import op3_simhash_near_dedup


def plain_print(text, k=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ")
             .replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_roots(prints, bits=4):
    """Smallest member of each component, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= bits:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {p: find(p) for p in root}


def plain_components(rows, bits=4):
    prints = [(i, plain_print(t)) for i, t in rows]
    roots = plain_roots({p for _, p in prints}, bits)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(
        ((i, f"{p:016x}", least.get(roots[p])) for i, p in prints), key=lambda r: str(r)
    )


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)[:: 1 << 6]
    index = simhash.decode(words)
    assert index.min() >= 0 and index.max() < 1 << 12
    single, errors = simhash._tables()
    assert sorted(np.bitwise_count(errors).tolist()) == [0] + [1] * 23 + [2] * 253 + [3] * 1771


def test_keys_meet_every_pair_within_four_bits():
    rng = random.Random(5)
    pairs = []
    for _ in range(4000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 5)):
            b ^= 1 << bit
        pairs.append((a, b))
    keys = {}
    flat = np.array([x for pair in pairs for x in pair], np.uint64)
    for side, row, key in simhash.keys_of(flat):
        for r, k in zip(row.tolist(), key.tolist(), strict=True):
            keys.setdefault(r, {}).setdefault(side, set()).add(k)
    for i in range(0, len(flat), 2):
        a, b = keys[i], keys[i + 1]
        assert a[2] & b[2] or a[0] & b[1], hex(int(flat[i] ^ flat[i + 1]))


@pytest.mark.parametrize("bits", [4, 2])
def test_links_equal_all_pairs(spark, bits):
    rng = random.Random(9)
    prints = []
    for _ in range(40):  # chains, stars and dense groups
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 10, 40])):
            prints.append(at)
            step = at if rng.random() < 0.5 else prints[-1]
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                step ^= 1 << bit
            prints.append(step)
            at = step if rng.random() < 0.3 else at
    want = plain_roots(set(prints), bits)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    got = simhash.link_groups(spark.createDataFrame(signed, "fp long"), bits).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.fp % (1 << 64))
    other = {}
    for p, r in want.items():
        other.setdefault(r, set()).add(p)
    assert len(got) == len(want)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_query_equals_brute_force(spark, docs):
    got = op3_simhash_near_dedup(spark, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_components(rows)
    assert sorted(map(tuple, got.collect()), key=lambda r: str(r)) == want


def test_odd_texts(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, got.collect()), key=lambda r: str(r)) == plain_components(rows)
    assert simhash.near_duplicates(no_docs).collect() == []


def test_keep_first_keeps_columns_and_one_of_each_group(odd_docs, no_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == [0, 1, 4, 6, 7, 8, 9, 9, None]
    assert simhash.keep_first(no_docs).collect() == []


def test_rows_decide_which_document_stays(spark):
    a, b, c = "one two three four five six", "Some other text of a few words", "a third one, quite unlike"
    rows = [(5, a, "x"), (5, b, "x"), (3, b.lower(), "x"), (9, c, "x"), (9, c, "x"), (None, c, "x"),
            (None, "nobody's own text", "x"), (None, "nobody's own text", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string")
    want = [(3, b.lower(), "x"), (5, a, "x"), (9, c, "x"), (None, "nobody's own text", "x")]
    kept = simhash.keep_first(frame, repeats=False)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    repeated = simhash.keep_first(frame).collect()
    assert sorted(map(tuple, repeated), key=str) == sorted([*want, (9, c, "x")], key=str)


def test_the_stage_keeps_one_row_of_a_repeated_document(spark, odd_docs, no_docs):
    kept = corpus_pipeline.deduplicated(spark, odd_docs.union(odd_docs), SF).collect()
    ids = sorted((r.doc_id for r in kept), key=lambda i: (i is None, i))
    assert ids == [0, 1, 4, 6, 7, 8, 9, None]
    assert corpus_pipeline.deduplicated(spark, no_docs, SF).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, 7)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(x, find(x)) for x in root if find(x) != x}
    got = components(spark.createDataFrame(edges, "a long, b long")).where("node <> root")
    assert set(map(tuple, got.collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keys_are_never_broadcast(spark):
    """Spark sizes the some sixty keys of a fingerprint like the fingerprint itself."""
    prints = spark.range(50).select(F.xxhash64("id").alias("fp"), F.xxhash64("id").alias("grp"))
    for links in (simhash._hub_links, simhash._cross_links):
        plan = links(prints, 4)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
