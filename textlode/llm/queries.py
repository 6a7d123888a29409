"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.sources.tables import read_table

from . import (
    ann,
    bpe,
    collocation,
    html_text,
    langid,
    mixing,
    quality,
    sharding,
    simhash,
    sketch,
    spelling,
    warc,
    wavelet,
)
from .common import remainder

#: Vocabulary file that the token operators use; a parameter of theirs.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(read_table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read_table(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, shingle=4, max_bits=4)


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the documents that are not held out."""
    return langid.train(docs.where(remainder("doc_id", 4) != 2))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_model(docs)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    found = langid.predict(docs.select("doc_id", held_out, "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mixing.replicate(docs, copy="copy", rate="rate")
    return mixed.select("doc_id", "source", "copy", F.round("rate", 6).alias("rate"), "text")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(read_table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_digests(read_table(spark, sf_dir, "documents"), TOKENIZER)


def quality_machine(docs: DataFrame, labels: DataFrame) -> quality.Machine:
    """Learned from the labels that are not held out."""
    return quality.train(docs, labels.where(remainder("doc_id", 5) != 0))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    machine = quality_machine(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    found = quality.score(docs.select("doc_id", held_out, "text", "n_chars"), machine)
    predicted = F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted")
    return found.select("doc_id", "held_out", "score", predicted)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(read_table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(read_table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_html_extraction,
    op2_warc,
    op3_simhash_near_dedup,
    op4_language_id,
    op5_mixing_sources,
    op6_document_fingerprints,
    op7_token_ids,
    op8_quality_classifier,
    op9_bpe,
    op10_nearest_neighbours,
    op11_spelling_variants,
    op12_sharding,
    op13_phrase_collocations,
)

OP2_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
    sha1(coalesce(html, '')) AS digest FROM pages),
m AS (
  SELECT *, CASE WHEN n >= {warc.REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY digest) END
    AS newest FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN newest <> page_id THEN newest END AS refers_to
FROM m
"""

OP5_SQL = f"""
WITH RECURSIVE s AS (
  SELECT source, sum(coalesce(length(text), 0) + 1) AS mass,
    pow(sum(coalesce(length(text), 0) + 1)::DOUBLE, {mixing.POWER}) AS weight
  FROM documents GROUP BY source),
r AS (
  SELECT source, weight / (SELECT sum(weight) FROM s) * (SELECT sum(mass) FROM s)::DOUBLE / mass
    AS rate FROM s),
q AS (
  SELECT source, rate, greatest(ceil(rate / {mixing.MEAN}), 1)::INT AS parts,
    rate / greatest(ceil(rate / {mixing.MEAN}), 1) AS mean FROM r),
c AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM q
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM c
  WHERE k < ceil(mean + 10 * sqrt(mean) + 30)),
l AS (SELECT source, list(c ORDER BY k) AS cdf FROM c GROUP BY source),
u AS (
  SELECT d.doc_id, d.source, d.text, q.rate, unnest(range(q.parts)) AS part, l.cdf
  FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source
    JOIN l ON d.source IS NOT DISTINCT FROM l.source),
n AS (
  SELECT doc_id, source, text, rate, sum(len(list_filter(cdf, lambda x : x <=
    ('0x' || md5('{mixing.SEED}:' || part || ':' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))[1:13])::UBIGINT
    / {float(16**13)!r}))) AS n FROM u GROUP BY ALL)
SELECT doc_id, source, unnest(range(1, n::BIGINT + 1)) AS copy, round(rate, 6) AS rate, text FROM n
WHERE n > 0
"""

#: CRC-32 of a string column, by a table that its polynomial gives.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"""


def crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of an SQL expression; ``crc`` is the column of the table."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {octets}), "
        "lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"
    )


OP11_SQL = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS k FROM r WHERE length(w) >= {spelling.LEAST_LETTERS} GROUP BY ALL),
h AS (SELECT w, k, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM c, t),
e AS (
  SELECT CASE WHEN h % {spelling.EDIT_EVERY} = 0
    THEN substring(w, 1, (h % length(w))::INT) || substring(w, (h % length(w))::INT + 2) ELSE w END AS word, k
  FROM h),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM e WHERE length(word) >= {spelling.LEAST_LETTERS}
  GROUP BY word HAVING sum(k) >= {spelling.LEAST_COUNT}),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
v AS (SELECT word, n, i, substring(word, 1, i::INT) || substring(word, i::INT + 2) AS cut FROM i),
d AS (SELECT DISTINCT v.word AS long, v.n AS long_n, w.word AS short, w.n AS short_n
  FROM v JOIN words w ON v.cut = w.word),
pairs AS (
  SELECT long AS word, short AS near, short_n AS near_n FROM d
  UNION ALL SELECT short, long, long_n FROM d
  UNION ALL SELECT x.word, y.word, y.n FROM v x JOIN v y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word),
best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(n := -near_n, w := encode(near))) AS b FROM pairs GROUP BY word),
f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -b.n >= {spelling.OUTNUMBERS} * n THEN decode(b.w) END AS form,
    CASE WHEN -b.n >= {spelling.OUTNUMBERS} * n THEN -b.n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
g AS (
  SELECT word, word AS root, form AS onward FROM f
  UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON g.onward = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN g ON f.word = g.word AND g.onward IS NULL
"""

OP12_SQL = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text) NULLS FIRST) - 1 AS x,
    count(*) OVER () AS n FROM documents, t),
s AS (SELECT *, ceil(sqrt(n))::BIGINT AS a FROM d),
b AS (SELECT *, (n + a - 1) // a AS b FROM s),
w AS (
  SELECT x, n, a, b, x % a AS l, x // a AS r, 0 AS j FROM b
  UNION ALL
  SELECT x, n, a, b,
    CASE WHEN j % 2 = 0 THEN (l + ('0x' || md5('{sharding.SEED}:' || j % {sharding.ROUNDS} || ':' || r)[1:13])::BIGINT) % a
      ELSE l END,
    CASE WHEN j % 2 = 1 THEN (r + ('0x' || md5('{sharding.SEED}:' || j % {sharding.ROUNDS} || ':' || l)[1:13])::BIGINT) % b
      ELSE r END, j + 1
  FROM w WHERE j = 0 OR j % {sharding.ROUNDS} <> 0 OR r * a + l >= n),
p AS (SELECT x, r * a + l AS p FROM w WHERE j > 0 AND j % {sharding.ROUNDS} = 0 AND r * a + l < n)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p % {sharding.SHARDS})::INT AS shard,
  p // {sharding.SHARDS} AS slot, NULL::INT AS grown_shard FROM b JOIN p USING (x)
"""


OP13_SQL = f"""
WITH x AS (
  SELECT coalesce(lang, '{collocation.NO_LANGUAGE}') AS lang, unnest(regexp_split_to_array(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM x),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS ids
  FROM p, range(1, {collocation.MOST_WORDS + 1}) t(k) WHERE len(w) >= k),
f AS (SELECT lang, ids, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {collocation.LEAST_COUNT}),
c AS (SELECT lang, ids, k, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.ids, c.k, a, cut, l.f AS l, r.f AS r, n.n,
    ((1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN n ON c.lang = n.lang
    JOIN f l ON l.lang = c.lang AND l.ids = c.ids[1:cut]
    JOIN f r ON r.lang = c.lang AND r.ids = c.ids[cut + 1:c.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ids ORDER BY score, cut) = 1),
i AS (
  SELECT lang, unnest([ids[1:k - 1], ids[2:k]]) AS ids, f FROM f WHERE k > 2),
m AS (SELECT lang, ids, max(f) AS f FROM i GROUP BY ALL),
z AS (
  SELECT b.lang, array_to_string(b.ids, ' ') AS phrase, a, l, r, n, score
  FROM b LEFT JOIN m ON b.lang = m.lang AND b.ids = m.ids WHERE m.f IS NULL OR m.f < a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, score
FROM z QUALIFY rank <= {collocation.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": OP2_SQL,
        "op5_mixing_sources": OP5_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_sharding": OP12_SQL,
        "op13_phrase_collocations": OP13_SQL,
    }
