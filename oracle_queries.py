"""DuckDB SQL equivalents of the registered queries.

Each function builds the SQL of one step as common table expressions over the same
tables.  Word list and suffix tables are the published values that the engine uses
too; what is done with them is written here anew.
"""

from __future__ import annotations

from html.entities import name2codepoint

from textlode.functions.stopwords import load_stopwords

TOKEN = r"\p{L}+|\p{N}+|[^\s\v\p{L}\p{N}\x{85}\x{A0}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def stop_list() -> str:
    return ", ".join(quoted(w) for w in load_stopwords())


def raw_tokens(name: str, source: str, key: str = "doc_id", text: str = "text") -> str:
    """key, token: every raw token, with the empty one after trailing space."""
    return rf"""{name} AS (
      SELECT {key}, unnest(CASE WHEN regexp_matches({text}, '[\s\v\x{{85}}\x{{A0}}]\z')
                THEN list_append(regexp_extract_all({text}, '{TOKEN}'), '')
                ELSE regexp_extract_all({text}, '{TOKEN}') END) AS token
      FROM {source})"""


def kept_words(name: str, source: str, key: str = "doc_id", text: str = "text") -> str:
    """key, token: upper-case words that are not stopwords."""
    return f"""{raw_tokens(name + '_raw', source, key, text)},
    {name} AS (SELECT {key}, upper(token) AS token FROM {name}_raw
      WHERE upper(token) NOT IN ({stop_list()}))"""


def stemmed(name: str, source: str, key: str = "doc_id", text: str = "text") -> str:
    return rf"""{kept_words(name + '_kept', source, key, text)},
    {name} AS (SELECT {key}, regexp_replace(token, '^(.{{2,}})Y$', '\1i') AS token
      FROM {name}_kept)"""


def gram_list(token: str, n: int) -> str:
    return (
        f"list_transform(range(1, greatest(length({token}) - {n}, 0) + 1), "
        f"lambda i: substring({token}, i, {n}))"
    )


def index_tokens(name: str, source: str, key: str = "doc_id", text: str = "text") -> str:
    """key, token: every occurrence of every index token."""
    return f"""{stemmed(name + '_stem', source, key, text)},
    {name} AS (SELECT {key}, unnest([token] || {gram_list('token', 3)} ||
      {gram_list('token', 5)} || {gram_list('token', 7)}) AS token FROM {name}_stem)"""


def postings(name: str, source: str, key: str = "doc_id", text: str = "text") -> str:
    """doc_id, token, tf"""
    return f"""{index_tokens(name + '_tok', source, key, text)},
    {name} AS (SELECT {key} AS doc_id, token, count(*) AS tf FROM {name}_tok GROUP BY 1, 2)"""


def stats(name: str, posted: str, source: str, mode: str) -> str:
    """token, df, n_docs, idf of a mode; nothing pruned."""
    if mode == "float":
        n_docs, idf = f"(SELECT count(*) FROM {source})", "ln(n_docs / df)"
    else:
        n_docs, idf = f"(SELECT count(DISTINCT doc_id) FROM {posted})", "ln(n_docs // df)"
    return f"""{name} AS (SELECT *, {idf} AS idf FROM (
      SELECT token, count(*) AS df, {n_docs} AS n_docs FROM {posted} GROUP BY token))"""


def corpus(mode: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """p: postings, s: statistics"""
    return f"{postings('p', source, key, text)}, {stats('s', 'p', source, mode)}"


def single_query(search: str, mode: str, limit: int | None = None) -> str:
    """doc_id, score of one search text."""
    known = ""
    if mode == "float":
        known = "AND (SELECT count(*) FROM q) = (SELECT count(*) FROM q JOIN s USING (token))"
    top = f"ORDER BY score DESC, doc_id LIMIT {limit}" if limit is not None else ""
    return f"""WITH {corpus(mode)},
    one AS (SELECT 0 AS doc_id, {quoted(search)} AS text),
    {index_tokens('qt', 'one')},
    q AS (SELECT DISTINCT token FROM qt),
    raw AS (SELECT doc_id, sum(tf * idf) AS score FROM p JOIN s USING (token)
      JOIN q USING (token) GROUP BY doc_id)
    SELECT doc_id, round(score, 6) AS score FROM raw WHERE score > 0 {known} {top}"""


def batch_query(
    requests: str, mode: str, source: str = "documents", key: str = "doc_id", text: str = "text"
) -> str:
    """query_id, doc_id, score, rank for requests (query_id, search, top_n)."""
    known = ""
    if mode == "float":
        known = """WHERE query_id NOT IN (
          SELECT query_id FROM q LEFT JOIN s USING (token) WHERE df IS NULL)"""
    return f"""WITH req AS ({requests}), {corpus(mode, source, key, text)},
    {index_tokens('qt', 'req', 'query_id', 'search')},
    q AS (SELECT DISTINCT query_id, token FROM qt),
    ok AS (SELECT * FROM q {known}),
    raw AS (SELECT query_id, doc_id, sum(tf * idf) AS score FROM ok JOIN s USING (token)
      JOIN p USING (token) GROUP BY ALL),
    pos AS (SELECT query_id, doc_id, round(score, 6) AS score FROM raw WHERE score > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, doc_id) AS rank FROM pos)
    SELECT query_id, doc_id, score, rank FROM ranked JOIN
      (SELECT query_id, CASE WHEN coalesce(top_n, 0) = 0 THEN 10 WHEN top_n < 0 THEN 1
        ELSE top_n END AS n FROM req)
      USING (query_id) WHERE rank <= n"""


def entity_map() -> str:
    table = {**{n: chr(c) for n, c in name2codepoint.items()}, "apos": "'"}
    keys = ", ".join(quoted(k) for k in table)
    values = ", ".join(quoted(v) for v in table.values())
    return f"map([{keys}], [{values}])"


PIECES = (
    r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>"
    r"""|<[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|<[^>]*>|[^<]+"""
)


def page_pieces(name: str) -> str:
    """page_id, pos, piece"""
    return f"""{name} AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS piece
      FROM (SELECT page_id, regexp_extract_all(html, {quoted(PIECES)}) AS l FROM pages))"""


def decoded(value: str) -> str:
    """References replaced; the tables hold named references only."""
    ref = r"&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"
    return (
        f"array_to_string(list_transform(regexp_extract_all({value}, {quoted(ref)}), "
        f"lambda x: CASE WHEN regexp_matches(x, '^&.+;$') THEN "
        f"coalesce(ents[x[2:-2]], x) ELSE x END), '')"
    )


def page_texts(name: str) -> str:
    """page_id, text: character data, one blank after each run."""
    return f"""{page_pieces(name + '_pieces')},
    {name}_runs AS (SELECT page_id, pos, {decoded('piece')} AS run
      FROM (SELECT *, {entity_map()} AS ents FROM {name}_pieces)
      WHERE piece NOT LIKE '<%'),
    {name} AS (SELECT page_id, coalesce(string_agg(run || ' ', '' ORDER BY pos), '') AS text
      FROM pages LEFT JOIN {name}_runs USING (page_id) GROUP BY page_id)"""


def strict_texts() -> str:
    """page_id, text of strict reading: a recursive walk with the open elements."""
    name = r"[\p{L}_:][\p{L}\p{N}_:.\-]*"
    ref = r"&(?:lt|gt|amp|apos|quot|#[0-9]+|#x[0-9a-fA-F]+);"
    attribute = rf"""\s*{name}\s*=\s*(?:"(?:[^"<&]|{ref})*"|'(?:[^'<&]|{ref})*')"""
    start = quoted(rf"^<{name}(?:{attribute})*\s*/?>$")
    value = decoded("piece")
    return rf"""WITH RECURSIVE {page_pieces('pieces')},
    kinds AS (SELECT page_id, pos, piece, CASE
        WHEN piece LIKE '<!--%' THEN CASE WHEN contains(piece[5:-4], '--')
          OR piece LIKE '%--->' THEN 'bad' ELSE 'other' END
        WHEN piece LIKE '<!%' OR piece LIKE '<?%' THEN 'other'
        WHEN piece LIKE '</%' THEN
          CASE WHEN regexp_matches(piece, '^</{name}\s*>$') THEN 'end' ELSE 'bad' END
        WHEN piece LIKE '<%' THEN CASE WHEN NOT regexp_matches(piece, {start}) THEN 'bad'
          WHEN piece LIKE '%/>' THEN 'other' ELSE 'start' END
        WHEN regexp_matches(piece, '^(?:[^&]|{ref})*$') AND NOT contains(piece, ']]>')
          THEN 'text' ELSE 'bad' END AS kind,
      regexp_extract(piece, '^</?({name})', 1) AS name FROM pieces),
    walk AS (SELECT page_id, 0::BIGINT AS pos, []::VARCHAR[] AS open, false AS bad FROM pages
      UNION ALL
      SELECT k.page_id, k.pos, CASE kind WHEN 'start' THEN list_append(w.open, k.name)
          WHEN 'end' THEN w.open[:-2] ELSE w.open END,
        kind = 'bad' OR (kind = 'end' AND coalesce(w.open[-1], '') <> k.name)
      FROM walk w JOIN kinds k ON k.page_id = w.page_id AND k.pos = w.pos + 1 WHERE NOT w.bad),
    runs AS (SELECT page_id, pos, {value} AS run FROM (SELECT k.page_id, k.pos, piece,
        {entity_map()} AS ents FROM kinds k JOIN walk w
        ON k.page_id = w.page_id AND k.pos = w.pos WHERE kind = 'text' AND NOT bad))
    SELECT page_id, coalesce(string_agg(run || ' ', '' ORDER BY pos), '') AS text
    FROM pages LEFT JOIN runs USING (page_id) GROUP BY page_id"""


# -- English stems ---------------------------------------------------------
def case_of(column: str, pairs: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in pairs.items())
    return f"CASE {column} {whens} END"


def suffix_stage(name: str, source: str, endings: dict[str, str], allowed: str) -> str:
    """One suffix step: x is the ending found, b the word without it."""
    return f"""{name}_x AS (SELECT *, regexp_extract(s, '({'|'.join(endings)})$', 1) AS x
      FROM {source}),
    {name}_b AS (SELECT *, left(s, length(s) - length(x)) AS b FROM {name}_x),
    {name} AS (SELECT * EXCLUDE (s, x, b), CASE WHEN x <> '' AND ({allowed})
      THEN b || {case_of('x', endings)} ELSE s END AS s FROM {name}_b)"""


def stems(name: str, words: str) -> str:
    """word, stem of lower-case words."""
    from textlode.functions import porter2 as p

    short = "regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"
    double = f"regexp_matches(b, '({p.DOUBLES})$')"
    step = "[^aeiouy]*[aeiouy]+[^aeiouy]"
    r1, r2 = "length(b) >= r1", "length(b) >= r2"
    step_2 = f"""{r1} AND CASE x WHEN 'ogi' THEN b LIKE '%l'
      WHEN 'li' THEN regexp_matches(b, '[cdeghkmnrt]$') ELSE true END"""
    step_3 = f"{r1} AND (x <> 'ative' OR {r2})"
    step_4 = f"{r2} AND (x <> 'ion' OR regexp_matches(b, '[st]$'))"
    step_5 = f"""CASE x WHEN 'e' THEN {r2} OR ({r1} AND NOT {short.format('b')})
      ELSE {r2} AND b LIKE '%l' END"""
    kept = ", ".join(quoted(w) for w in p.KEPT_AFTER_PLURAL)
    whole = ", ".join(quoted(w) for w in p.WHOLE_WORDS)
    return rf"""{name}_0 AS (SELECT word, regexp_replace(regexp_replace(regexp_replace(
        word, '^''', ''), '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS s FROM {words}),
    {name}_1 AS (SELECT *, CASE WHEN regexp_matches(s, '^(gener|commun|arsen|{step})')
      THEN length(regexp_extract(s, '^(?:gener|commun|arsen|{step})')) ELSE length(s) END AS r1
      FROM {name}_0),
    {name}_2 AS (SELECT *, CASE WHEN regexp_matches(substring(s, r1 + 1), '^{step}')
      THEN r1 + length(regexp_extract(substring(s, r1 + 1), '^{step}'))
      ELSE length(s) END AS r2 FROM {name}_1),
    {name}_3 AS (SELECT * REPLACE (regexp_replace(s, '(''s''|''s|'')$', '') AS s)
      FROM {name}_2),
    {name}_4 AS (SELECT * REPLACE (CASE
        WHEN s LIKE '%sses' THEN left(s, length(s) - 2)
        WHEN regexp_matches(s, '^..+ie[sd]$') THEN left(s, length(s) - 2)
        WHEN regexp_matches(s, 'ie[sd]$') THEN left(s, length(s) - 1)
        WHEN regexp_matches(s, '[us]s$') THEN s
        WHEN regexp_matches(s, '[aeiouy].+s$') THEN left(s, length(s) - 1)
        ELSE s END AS s) FROM {name}_3),
    {name}_5 AS (SELECT *, s AS plural, regexp_extract(s, '(eed|eedly|ed|edly|ing|ingly)$', 1)
      AS x FROM {name}_4),
    {name}_6 AS (SELECT *, left(s, length(s) - length(x)) AS b FROM {name}_5),
    {name}_7 AS (SELECT * EXCLUDE (x, b) REPLACE (CASE
        WHEN x IN ('eed', 'eedly') THEN CASE WHEN {r1} THEN b || 'ee' ELSE s END
        WHEN x = '' OR NOT regexp_matches(b, '[aeiouy]') THEN s
        WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
        WHEN {double} THEN CASE WHEN regexp_matches(b, '^[aeo]..$') THEN b
          ELSE left(b, length(b) - 1) END
        WHEN length(b) = r1 AND {short.format('b')} THEN b || 'e'
        ELSE b END AS s) FROM {name}_6),
    {name}_8 AS (SELECT * REPLACE (regexp_replace(s, '^(.+[^aeiouy])[yY]$', '\1i') AS s)
      FROM {name}_7),
    {suffix_stage(name + '_s2', name + '_8', p.STEP_2, step_2)},
    {suffix_stage(name + '_s3', name + '_s2', p.STEP_3, step_3)},
    {suffix_stage(name + '_s4', name + '_s3', dict.fromkeys(p.STEP_4, ''), step_4)},
    {suffix_stage(name + '_s5', name + '_s4', {'e': '', 'l': ''}, step_5)},
    {name} AS (SELECT word, CASE WHEN word IN ({whole}) THEN {case_of('word', p.WHOLE_WORDS)}
      WHEN length(word) < 3 THEN word
      WHEN plural IN ({kept}) THEN translate(plural, 'Y', 'y')
      ELSE translate(s, 'Y', 'y') END AS stem FROM {name}_s5)"""


# -- byte mode -------------------------------------------------------------
VALID = (
    r"[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]"
    r"|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]"
    r"|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}"
    r"|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2}"
)


def byte_form(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda x: chr(('0x' || x)::INT)), '')"
    )


def byte_text(token: str) -> str:
    parts = rf"regexp_extract_all({token}, '{VALID}|[\x00-\x7F]|[\x{{80}}-\x{{FF}}]')"
    blob = (
        "decode(unhex(array_to_string(list_transform(regexp_extract_all(m, '(?s).'), "
        "lambda c: printf('%02x', unicode(c))), '')))"
    )
    return (
        f"array_to_string(list_transform({parts}, lambda m: CASE WHEN length(m) = 1 "
        f"AND unicode(m) >= 128 THEN chr(65533) ELSE {blob} END), '')"
    )


def byte_mode() -> str:
    return rf"""WITH form AS (SELECT doc_id, {byte_form('text')} AS text FROM documents),
    {raw_tokens('raw', 'form')},
    uniq AS (SELECT token, count(*) AS n FROM raw GROUP BY 1),
    up AS (SELECT upper({byte_text('token')}) AS token, n FROM uniq),
    kept AS (SELECT * FROM up WHERE token NOT IN ({stop_list()})),
    stem AS (SELECT CASE WHEN token LIKE '%' || chr(65533) || 'Y' THEN token
      ELSE regexp_replace(token, '^(.{{2,}})Y$', '\1i') END AS token, n FROM kept),
    word AS (SELECT {byte_form('token')} AS token, n FROM stem),
    gram AS (SELECT unnest([token] || {gram_list('token', 3)} || {gram_list('token', 5)}
      || {gram_list('token', 7)}) AS token, n FROM word)
    SELECT token, sum(n)::BIGINT AS n FROM gram GROUP BY 1"""


# -- everything ------------------------------------------------------------
def counts(cte: str, name: str) -> str:
    return f"WITH {cte} SELECT token, count(*) AS n FROM {name} GROUP BY 1"


def stats_query(mode: str, where: str = "", columns: str = "token, df, n_docs") -> str:
    idf = ", round(idf, 9) AS idf" if columns.endswith("n_docs") else ""
    return f"WITH {corpus(mode)} SELECT {columns}{idf} FROM s {where}"


def last_turns(replace: bool) -> str:
    """Postings of conversations whose turns are applied in order."""
    turns = "SELECT conv_id AS doc_id, turn AS seq, text FROM conversations"
    if replace:
        turns += " QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)"
    return rf"""WITH t AS ({turns}),
    {index_tokens('tok', 't', 'doc_id, seq')},
    c AS (SELECT doc_id, seq, token, count(*) AS tf FROM tok GROUP BY ALL),
    l AS (SELECT doc_id, token, max_by(tf, seq) AS tf FROM c GROUP BY ALL)"""


def turn_source(role: str, key: str, text: str) -> str:
    return (
        f"SELECT conv_id * 1000 + turn AS {key}, text AS {text} FROM conversations "
        f"WHERE role = '{role}'"
    )


def upserted(first: str, second: str) -> str:
    """l: postings after the rows of ``second`` (tokens b) came over those of ``first`` (a)."""
    return f"""{first}, {second}, c AS (SELECT 0 AS b, doc_id, token, count(*) AS tf FROM a
      GROUP BY ALL UNION ALL SELECT 1, doc_id, token, count(*) FROM b GROUP BY ALL),
      l AS (SELECT doc_id, token, max_by(tf, b) AS tf FROM c GROUP BY ALL)"""


def search_over(posted: str, query: str, limit: int) -> str:
    """Pruned search of the tokens q over postings; both are names of tables."""
    return f"""{stats('s', posted, posted, 'pruned')},
      raw AS (SELECT doc_id, sum(tf * idf) AS score FROM {posted} JOIN s USING (token)
        JOIN (SELECT DISTINCT token FROM {query}) USING (token) GROUP BY doc_id)
      SELECT doc_id, round(score, 6) AS score FROM raw WHERE score > 0
      ORDER BY score DESC, doc_id LIMIT {limit}"""


def stem_search(known: str, limit: int) -> str:
    """Search where documents and query have stems of their words."""
    grams = f"[w] || {gram_list('w', 3)} || {gram_list('w', 5)} || {gram_list('w', 7)}"
    return f"""WITH {kept_words('kd', 'documents')},
      one AS (SELECT 0 AS doc_id, {quoted(known)} AS text), {kept_words('kq', 'one')},
      v AS (SELECT lower(token) AS word FROM kd UNION SELECT lower(token) FROM kq),
      {stems('st', 'v')},
      wd AS (SELECT doc_id, stem AS w FROM kd JOIN st ON lower(token) = word),
      wq AS (SELECT stem AS w FROM kq JOIN st ON lower(token) = word),
      td AS (SELECT doc_id, unnest({grams}) AS token FROM wd),
      q AS (SELECT unnest({grams}) AS token FROM wq),
      p AS (SELECT doc_id, token, count(*) AS tf FROM td GROUP BY ALL),
      {search_over('p', 'q', limit)}"""


def registered(known: str, unknown: str, benchmark: str) -> dict[str, str]:
    raw = raw_tokens("raw", "documents")
    virtual = f"""{page_texts('t')}, files AS (SELECT '/site/v1.0/' || page_id || '.' ||
      ['html', 'xml', 'txt', 'pdf'][page_id % 4 + 1] AS doc_id, page_id % 4 AS kind,
      html, t.text FROM pages JOIN t USING (page_id))"""
    events = rf"""{page_pieces('pieces')}, kinds AS (SELECT page_id, piece, CASE
        WHEN piece LIKE '<![CDATA[%' THEN 'chardata' WHEN piece LIKE '<!--%' THEN 'comment'
        WHEN piece LIKE '<?%' THEN 'procinst' WHEN piece LIKE '<!%' THEN 'directive'
        WHEN piece LIKE '</%' THEN 'end' WHEN piece LIKE '<%' THEN 'start'
        ELSE 'chardata' END AS kind FROM pieces),
      named AS (SELECT page_id, kind, piece, CASE
        WHEN kind = 'start' THEN regexp_extract(piece, '^<\s*([^\s/>]+)', 1)
        WHEN kind = 'end' THEN regexp_extract(piece, '^</\s*([^\s>]*)', 1) END AS name
        FROM kinds),
      ev AS (SELECT kind, name, piece FROM named UNION ALL SELECT 'end', name, piece FROM named
        WHERE kind = 'start' AND (piece LIKE '%/>' OR lower(name) IN ('area', 'base',
        'basefont', 'br', 'col', 'frame', 'hr', 'img', 'input', 'isindex', 'link', 'meta',
        'param')))"""
    page_docs = page_texts("d")
    markup_batch = batch_query(benchmark, "pruned", "d", "page_id")
    markup_batch = markup_batch.replace("WITH req AS", f"WITH {page_docs}, req AS", 1)
    turns = batch_query(
        turn_source("user", "query_id", "search").replace(" FROM", ", 3 AS top_n FROM", 1),
        "pruned",
        "a",
        "id",
    ).replace("WITH req AS", f"WITH a AS ({turn_source('assistant', 'id', 'text')}), req AS", 1)
    words = f"{kept_words('kept', 'documents')}, v AS (SELECT DISTINCT lower(token) AS word FROM kept)"
    top = single_query(known, "float", 10)
    both = f"{index_tokens('a', 'documents')}, {page_texts('t')}, {index_tokens('b', 't', 'page_id')}"
    return {
        "tokenize_counts": counts(raw, "raw"),
        "normalize_case_counts": f"WITH {raw} SELECT upper(token) AS token, count(*) AS n "
        "FROM raw GROUP BY 1",
        "stopword_filter_counts": counts(kept_words("w", "documents"), "w"),
        "stopword_table_counts": f"WITH {raw} SELECT upper(token) AS token, count(*) AS n FROM raw "
        "WHERE upper(token) NOT IN (SELECT upper(lang) FROM documents) GROUP BY 1",
        "stem_reference_tokens": counts(stemmed("w", "documents"), "w"),
        "ngram_counts": f"WITH {stemmed('w', 'documents')}, g AS ("
        + " UNION ALL ".join(
            f"SELECT {n} AS size, unnest({gram_list('token', n)}) AS token FROM w"
            for n in (3, 5, 7)
        )
        + ") SELECT size, token, count(*) AS n FROM g GROUP BY ALL",
        "analyze_counts": counts(index_tokens("t", "documents"), "t"),
        "analyze_arrays": f"WITH {index_tokens('t', 'documents')} SELECT doc_id, "
        "count(token) AS n_tokens, count(DISTINCT token) AS n_distinct, max(token) AS last_token "
        "FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id",
        "stem_vocabulary": f"WITH {words}, {stems('st', 'v')} SELECT word, stem FROM st",
        "stem_vocabulary_counts": f"""WITH {words}, {stems('st', 'v')},
          w AS (SELECT stem AS token FROM kept JOIN st ON lower(token) = word)
          SELECT t AS token, count(*) AS n FROM (SELECT unnest([token] || {gram_list('token', 3)}
          || {gram_list('token', 5)} || {gram_list('token', 7)}) AS t FROM w) GROUP BY 1""",
        "byte_mode_counts": byte_mode(),
        "custom_tokenizer_counts": rf"""WITH raw AS (SELECT upper(unnest(
          regexp_extract_all(text, '[^ \n]+'))) AS token FROM documents)
          SELECT regexp_replace(token, '^(.{{2,}})Y$', '\1i') AS token, count(*) AS n
          FROM raw WHERE token NOT IN ({stop_list()}) GROUP BY 1""",
        "custom_stemmer_counts": f"""WITH {kept_words('k', 'documents')},
          w AS (SELECT left(token, 4) AS w FROM k)
          SELECT unnest([w] || {gram_list('w', 3)}) AS token, count(*) AS n FROM w GROUP BY 1""",
        "term_frequency_by_document": f"""WITH {postings('p', 'documents')} SELECT doc_id,
          count(*) AS n_postings, sum(tf)::BIGINT AS n_tokens, max(tf) AS max_tf,
          sum(tf * length(token))::BIGINT AS n_chars FROM p GROUP BY 1""",
        "term_frequency_top": f"WITH {postings('p', 'documents')} SELECT doc_id, token, tf FROM p "
        "ORDER BY tf DESC, doc_id, token LIMIT 1000",
        "document_frequency": f"WITH {postings('p', 'documents')} SELECT token, count(*) AS df "
        "FROM p GROUP BY 1",
        "total_documents": f"""WITH {postings('p', 'documents')}
          SELECT 'float' AS mode, count(*) AS n_docs FROM documents UNION ALL
          SELECT 'pruned', count(DISTINCT doc_id) FROM p""",
        "idf_float": stats_query("float"),
        "idf_integer": stats_query("pruned"),
        "pruned_stats": stats_query("pruned", "WHERE idf <> 0"),
        "pruned_tokens": stats_query("pruned", "WHERE idf = 0", "token, df"),
        "attach_stats": f"""WITH {corpus('pruned')} SELECT doc_id, count(*) AS n_postings,
          sum(df)::BIGINT AS sum_df, max(n_docs) AS n_docs, round(sum(tf * idf), 4) AS weight
          FROM p JOIN s USING (token) WHERE idf <> 0 GROUP BY 1""",
        "lookup_tf": f"""WITH {postings('p', 'documents')}, pairs AS (SELECT DISTINCT doc_id,
          unnest([upper(lang), upper(source), '.', ',']) AS token FROM documents)
          SELECT doc_id, token, coalesce(tf, 0) AS tf FROM pairs LEFT JOIN p USING (doc_id, token)""",
        "query_float": single_query(known, "float"),
        "query_pruned": single_query(known, "pruned"),
        "query_top_n": top,
        "unknown_term_float": single_query(unknown, "float"),
        "unknown_term_pruned": single_query(unknown, "pruned"),
        "distinct_query_tokens": f"""WITH req AS ({benchmark}),
          {index_tokens('q', 'req', 'query_id', 'search')}
          SELECT query_id, count(DISTINCT token) AS n FROM q GROUP BY 1""",
        "match_query_tokens": f"""WITH {postings('p', 'documents')},
          one AS (SELECT 0 AS doc_id, {quoted(known)} AS text), {index_tokens('q', 'one')}
          SELECT token, count(*) AS n_docs, sum(tf)::BIGINT AS sum_tf FROM p
          WHERE token IN (SELECT token FROM q) GROUP BY 1""",
        "search_batch_float": batch_query(benchmark, "float"),
        "search_batch_pruned": batch_query(benchmark, "pruned"),
        "search_conversations": turns,
        "format_results": f"""SELECT doc_id AS "docId", score,
          printf('%.2f', score) AS score_text FROM ({top})""",
        "results_json": f"""SELECT '{{"docId":' || doc_id || ',"score":' ||
          score::DECIMAL(18,6) || '}}' AS response FROM ({top})""",
        "upsert_latest": last_turns(False) + """ SELECT doc_id, count(*) AS n_postings,
          sum(tf)::BIGINT AS sum_tf, sum(tf * length(token))::BIGINT AS weight
          FROM l GROUP BY 1""",
        "upsert_replace": last_turns(True) + """ SELECT doc_id, count(*) AS n_postings,
          sum(tf)::BIGINT AS sum_tf FROM l GROUP BY 1""",
        "bulk_update": f"""WITH {both}, c AS (SELECT 0 AS b, doc_id, token, count(*) AS tf FROM a
          GROUP BY ALL UNION ALL SELECT 1, page_id, token, count(*) FROM b GROUP BY ALL),
          l AS (SELECT doc_id, token, max_by(tf, b) AS tf FROM c GROUP BY ALL)
          SELECT doc_id, count(*) AS n_postings, sum(tf)::BIGINT AS sum_tf FROM l GROUP BY 1""",
        "update_stream": last_turns(False) + " SELECT token, count(*) AS df FROM l GROUP BY 1",
        "index_tables": f"""WITH {postings('p', 'documents')} SELECT token,
          sum(tf)::BIGINT AS sum_tf, count(*) AS df FROM p GROUP BY 1""",
        "index_search": single_query(known, "pruned", 25),
        "index_search_blocks": batch_query(benchmark, "float"),
        "index_rebuild": f"""WITH {postings('p', 'documents')} SELECT token,
          sum(tf)::BIGINT AS sum_tf, count(*) AS df, (SELECT count(*) FROM documents) AS n_docs,
          (SELECT count(DISTINCT doc_id) FROM p) AS n_with_tokens FROM p GROUP BY 1""",
        "index_upsert": f"""WITH {upserted(index_tokens('a', 'documents'),
          f"{page_texts('t')}, pt AS (SELECT page_id AS doc_id, text FROM t), "
          + index_tokens('b', 'pt'))}, one AS (SELECT 0 AS doc_id, {quoted(known)} AS text),
          {index_tokens('q', 'one')}, {search_over('l', 'q', 25)}""",
        "update_one": f"""WITH {upserted(index_tokens('a', 'documents'),
          f"one AS (SELECT (SELECT min(doc_id) FROM documents) AS doc_id, {quoted(known)} AS text), "
          + index_tokens('b', 'one'))} SELECT token, count(*) AS df, sum(tf)::BIGINT AS sum_tf,
          (SELECT count(*) FROM documents) AS n_docs FROM l GROUP BY 1""",
        "update_stream_batches": last_turns(False) + """ SELECT token, count(*) AS df,
          sum(tf)::BIGINT AS sum_tf FROM l GROUP BY 1""",
        "replace_across_batches": last_turns(True) + """ SELECT doc_id, count(*) AS n_postings,
          sum(tf)::BIGINT AS sum_tf, (SELECT count(DISTINCT doc_id) FROM l) AS n_with_tokens,
          (SELECT sum(df) FROM (SELECT count(*) AS df FROM l GROUP BY token))::BIGINT AS sum_df
          FROM l GROUP BY 1""",
        "search_batch_large_top_n": batch_query(
            benchmark.replace("CASE WHEN length(text) % 12 <> 1 THEN length(text) % 12 END",
              "CASE item_id % 20 WHEN 0 THEN 5000 WHEN 1 THEN -1 ELSE item_id % 4 END"), "pruned"),
        "stopword_table_search": single_query(known, "pruned", 25).replace(
            f"({stop_list()})", "(SELECT upper(lang) FROM documents)"
        ),
        "stem_vocabulary_search": stem_search(known, 25),
        "tf_map_documents": """SELECT regexp_matches(text, '[0-9]') AS has_tokens,
          count(*) AS n FROM documents GROUP BY 1""",
        "compact_index": f"""WITH {postings('p', 'documents')} SELECT token,
          sum(tf)::BIGINT AS sum_tf, count(*) AS df FROM p GROUP BY 1""",
        "tf_map_roundtrip": f"""WITH {postings('p', 'documents')} SELECT token, count(*) AS df,
          sum(tf)::BIGINT AS sum_tf, (SELECT count(*) FROM documents) AS n_docs FROM p GROUP BY 1""",
        "read_documents_chars": "SELECT source, sum(length(text) + 1)::BIGINT AS n_chars "
        "FROM documents GROUP BY 1",
        "read_every_file": "SELECT source, sum(length(text) + 1)::BIGINT AS n_chars "
        "FROM documents GROUP BY 1",
        "extract_documents_chars": f"""WITH {virtual}, x AS (SELECT doc_id,
          CASE WHEN kind < 2 THEN text ELSE html END AS text FROM files WHERE kind < 3)
          SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM x""",
        "read_errors": "SELECT '/site/v1.0/' || page_id || '.pdf' AS doc_id, "
        "'unsupported' AS error FROM pages WHERE page_id % 4 = 3",
        "markup_events_counts": f"WITH {events} SELECT kind, name, count(*) AS n FROM ev GROUP BY ALL",
        "markup_links": f"""WITH {events} SELECT regexp_extract(piece, 'href="([^"]*)"', 1)
          AS target, count(*) AS n FROM ev WHERE kind = 'start' AND name = 'a' GROUP BY 1""",
        "chardata_text": f"WITH {page_texts('t')} SELECT page_id, text FROM t",
        "strict_prefix_text": strict_texts(),
        "markup_text_search": markup_batch,
    }
