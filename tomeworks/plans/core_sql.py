"""The same queries as SQL, over the same tables."""

from __future__ import annotations

from tomeworks.plans.core_queries import CATALOGUE, EMPTY, EVALUATED

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_BLANKS = "\u00a0\u2002\u2009\u202f\u3000"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    for a, b in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "...")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    x = f"nfc_normalize(translate({x}, {lit(_WIDE + _BLANKS)}, {lit(_NARROW + ' ' * len(_BLANKS))}))"
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def unmarked(folded: str) -> str:
    return f"replace(replace(regexp_replace({folded}, '[\\x{{2D}}\\x{{2010}}-\\x{{2014}}]', ' ', 'g'), chr(39), ''), chr(8217), '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({unmarked(fold(x))}, '[\\p{{L}}\\p{{N}}]+')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}]+', ' ', 'g'))"


def metadata_form(x: str) -> str:
    return squeeze(unmarked(fold(f"coalesce({x}, '')")))


def phrase_form(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def key(toks: str) -> str:
    return f"array_to_string(list_sort({toks}), ' ')"


def values(wanted: dict[int, str]) -> str:
    return "(VALUES " + ", ".join(f"({n}::INTEGER, {lit(t)})" for n, t in sorted(wanted.items())) + ") v(query_nr, raw)"


DOCS = "docs AS MATERIALIZED (SELECT doc_id, gutenberg_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents)"
LINES = """lines AS (SELECT doc_id, gutenberg_id, text, string_split(text, chr(10)) AS l FROM docs),
marks AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)\\*\\*\\* START OF')), true), 0) AS s,
  coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)\\*\\*\\* END OF')), true), 0) AS e FROM lines),
bodies AS MATERIALIZED (SELECT doc_id, gutenberg_id, CASE WHEN s > 0 AND e > 0 THEN array_to_string(l[s + 1:e - 1], chr(10))
  WHEN s > 0 THEN array_to_string(l[s + 1:], chr(10))
  WHEN e > 0 THEN array_to_string(l[:e - 1], chr(10)) ELSE text END AS content FROM marks)"""
TOKS = f"tk AS MATERIALIZED (SELECT doc_id, gutenberg_id, coalesce({tokens('content')}, []) AS toks FROM bodies)"
TF = "tfs AS MATERIALIZED (SELECT gutenberg_id, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT gutenberg_id, unnest(toks) AS term FROM tk WHERE gutenberg_id IS NOT NULL) GROUP BY 1, 2)"
POST = """post AS MATERIALIZED (SELECT gutenberg_id, term, tf FROM tfs UNION ALL SELECT gutenberg_id, strip_accents(term), tf FROM tfs
  WHERE strip_accents(term) <> term),
lex AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY 1),
dl AS (SELECT gutenberg_id, CAST(sum(len(toks)) AS BIGINT) AS doc_len FROM tk WHERE gutenberg_id IS NOT NULL GROUP BY 1),
g AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM dl)"""
NORMS = """norms AS (SELECT p.gutenberg_id, sqrt(sum(pow((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 2))) AS doc_norm
  FROM post p JOIN lex USING (term) CROSS JOIN g GROUP BY 1)"""
INDEX = ",\n".join((DOCS, LINES, TOKS, TF, POST))
MERGED = """numbered AS (SELECT CAST(CAST(regexp_extract(gutenberg_id, '\\d+') AS BIGINT) AS VARCHAR) AS gid, * FROM metadata
  WHERE regexp_matches(gutenberg_id, '\\d')),
merged AS MATERIALIZED (SELECT gid AS gutenberg_id, {fields} FROM numbered GROUP BY gid),
flagged AS MATERIALIZED (SELECT m.*, CASE WHEN d.b IS NULL THEN 0 ELSE 1 END AS has_text FROM merged m LEFT JOIN (SELECT DISTINCT gutenberg_id AS b FROM documents) d ON d.b = m.gutenberg_id)""".replace(
    "{fields}",
    ", ".join(
        f"coalesce(array_to_string(list_sort(list(DISTINCT trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || {lit(_BLANKS)})) FILTER (WHERE trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || {lit(_BLANKS)}) <> '')), ';'), '') AS {c}"
        for c in ("title", "authors", "language", "bookshelf", "rights")
    ),
)


def asked(wanted: dict[int, str]) -> str:
    return f"""q AS MATERIALIZED (SELECT query_nr, raw, {tokens("raw")} AS toks FROM {values(wanted)}),
qu AS (SELECT query_nr, toks, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM q),
qt AS MATERIALIZED (SELECT query_nr, term, count(*) AS tf_q, min(pos) AS first_pos FROM
  (SELECT query_nr, term, pos FROM qu UNION ALL SELECT query_nr, strip_accents(term), len(any_value(toks)) + min(pos) FROM qu
  WHERE NOT list_contains(toks, strip_accents(term)) GROUP BY query_nr, strip_accents(term)) GROUP BY 1, 2),
trig AS MATERIALIZED (SELECT q.query_nr, q.raw, contains(q.raw, '"') OR (coalesce(c, 0) >= 4 AND coalesce(h, 0) / c > 0.6) AS fallback FROM q
  LEFT JOIN (SELECT query_nr, count(*) AS c, count(*) FILTER (WHERE df / n > 0.8) AS h FROM qt LEFT JOIN lex USING (term) CROSS JOIN g GROUP BY 1) s USING (query_nr))"""


BM25 = """bm AS MATERIALIZED (SELECT query_nr, gutenberg_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))), 6) AS score
  FROM (SELECT query_nr, term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM qt JOIN lex USING (term) CROSS JOIN g WHERE df < n / 2 AND df / n <= 0.8) t
  JOIN post USING (term) JOIN dl USING (gutenberg_id) CROSS JOIN g GROUP BY 1, 2)"""
VSM = """vt AS (SELECT query_nr, term, ln((n + 1) / (df + 1)) + 1 AS idf, (1 + ln(tf_q)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM qt
  JOIN lex USING (term) JOIN trig USING (query_nr) CROSS JOIN g WHERE NOT fallback),
vs AS MATERIALIZED (SELECT query_nr, gutenberg_id, round(any_value(dot) / (any_value(nq) * any_value(doc_norm)), 6) AS score FROM
  (SELECT query_nr, gutenberg_id, sum(w * (1 + ln(tf)) * idf) AS dot FROM vt JOIN post USING (term) GROUP BY 1, 2)
  JOIN (SELECT query_nr, sqrt(sum(w * w)) AS nq FROM vt GROUP BY 1) USING (query_nr) JOIN norms USING (gutenberg_id) GROUP BY 1, 2)"""
PHRASE = f"""ph AS MATERIALIZED (SELECT query_nr, fallback,
  coalesce(nullif({phrase_form("array_to_string(list_filter(list_transform(regexp_extract_all(raw, '" + chr(34) + "(.*?)" + chr(34) + "', 1), lambda x: trim(x)), lambda x: x <> ''), ' ')")}, ''), {phrase_form("raw")}) AS phrase FROM trig),
forms AS MATERIALIZED (SELECT gutenberg_id, {phrase_form("text")} AS form FROM docs WHERE gutenberg_id IS NOT NULL),
holds AS MATERIALIZED (SELECT DISTINCT query_nr, gutenberg_id FROM ph JOIN forms ON contains(form, phrase) WHERE fallback AND phrase <> ''),
fb AS MATERIALIZED (SELECT query_nr, gutenberg_id, score, false AS fallback_used FROM bm JOIN ph USING (query_nr) WHERE NOT (fallback
  AND phrase <> '')
 UNION ALL SELECT query_nr, gutenberg_id, CASE WHEN (query_nr, gutenberg_id) IN (SELECT query_nr, gutenberg_id FROM holds) THEN score + 5.0
  ELSE score END, true FROM
   (SELECT *, row_number() OVER (PARTITION BY query_nr ORDER BY score DESC, gutenberg_id) AS r FROM bm) JOIN ph USING (query_nr) WHERE fallback
  AND phrase <> '' AND r <= 5000
 UNION ALL SELECT query_nr, gutenberg_id, 5.0, true FROM (SELECT query_nr, gutenberg_id, row_number() OVER (PARTITION BY query_nr
  ORDER BY gutenberg_id) AS r FROM holds
   WHERE query_nr NOT IN (SELECT query_nr FROM bm)) WHERE r <= 200)"""


def structured(wanted: dict[int, str]) -> str:
    title, author, other = (metadata_form(x) for x in ("title", "authors", "language || ' ' || bookshelf || ' ' || rights"))
    alias = f"list_concat(list_distinct({tokens('raw')}), list_filter(list_distinct(list_transform({tokens('raw')}, lambda t: strip_accents(t))), lambda t: NOT list_contains({tokens('raw')}, t)))"
    del author
    return f"""sq AS MATERIALIZED (SELECT query_nr, {metadata_form("raw")} AS qn, {alias} AS qset, {key(tokens("raw"))} AS qk FROM {values(wanted)}),
sm AS MATERIALIZED (SELECT gutenberg_id, has_text, {title} AS tn, list_distinct({tokens("title")}) AS tt,
  list_distinct({tokens("authors")}) AS ta, list_distinct({tokens(other)}) AS tr,
  list_transform(list_filter(string_split(authors, ';'), lambda a: trim(a) <> ''), lambda a: {key(tokens("a"))}) AS ak FROM flagged),
sx AS MATERIALIZED (SELECT query_nr, gutenberg_id, has_text, len(list_intersect(qset, list_concat(tt, ta))) > 0 AS cand,
  10 * contains(tn, qn)::INT + 5 * (qk <> '' AND list_contains(ak, qk))::INT + 2 * len(list_intersect(qset, tt)) + len(list_intersect(qset,
  ta)) + len(list_intersect(qset, tr)) AS score FROM sm CROSS JOIN sq WHERE qn <> ''),
st AS MATERIALIZED (SELECT query_nr, gutenberg_id, CAST(score AS DOUBLE) AS score FROM sx JOIN (SELECT query_nr, bool_or(cand) AS narrow FROM sx
  GROUP BY 1) USING (query_nr)
  WHERE score > 0 AND has_text = 1 AND (cand OR NOT narrow))"""


def ranked(name: str, k: int = 100, columns: str = "query_nr, gutenberg_id, score", where: str = "true") -> str:
    return f"SELECT * FROM (SELECT {columns}, CAST(row_number() OVER (PARTITION BY query_nr ORDER BY score DESC, gutenberg_id) AS INTEGER) AS rank FROM {name} WHERE {where}) WHERE rank <= {k}"


def bm25(wanted: dict[int, str]) -> str:
    return f"WITH {INDEX}, {asked(wanted)}, {BM25} " + ranked("bm")


def vsm(wanted: dict[int, str]) -> str:
    return f"WITH {INDEX}, {NORMS}, {asked(wanted)}, {VSM} " + ranked("vs")


def fallback(wanted: dict[int, str]) -> str:
    return f"WITH {INDEX}, {asked(wanted)}, {BM25}, {PHRASE} " + ranked("fb", columns="query_nr, gutenberg_id, score, fallback_used")


def catalogue_search(wanted: dict[int, str]) -> str:
    return f"WITH {MERGED}, {structured(wanted)} " + ranked("st")


LISTS = f"""WITH {INDEX}, {NORMS}, {asked(EVALUATED)}, {BM25}, {VSM}, {PHRASE}, {MERGED}, {structured(EVALUATED)},
lists AS MATERIALIZED (SELECT query_nr, 'structured' AS model, rank, gutenberg_id, score FROM ({ranked("st")}) UNION ALL
 SELECT query_nr, 'vsm', rank, gutenberg_id, score FROM ({ranked("vs")}) UNION ALL SELECT query_nr, 'bm25', rank, gutenberg_id, score FROM ({ranked("fb")}))"""
BEST = LISTS + """,
best AS MATERIALIZED (SELECT query_nr, gutenberg_id, term AS token FROM (SELECT query_nr, gutenberg_id, term,
  row_number() OVER (PARTITION BY query_nr, gutenberg_id ORDER BY ln((n + 1) / (df + 1)) + 1 DESC, first_pos) AS r
  FROM qt JOIN lex USING (term) JOIN post USING (term) CROSS JOIN g WHERE (query_nr, gutenberg_id) IN (SELECT query_nr, gutenberg_id FROM lists)) WHERE r = 1)"""
SNIPPETS = BEST + f""",
sa AS (SELECT query_nr, gutenberg_id, token, doc_id, text, instr({fold("text")}, token) - 1 AS p0, length(text) AS n FROM best
  JOIN docs USING (gutenberg_id)),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_nr, gutenberg_id ORDER BY p0 < 0, doc_id) AS first FROM sa) WHERE first = 1),
s0 AS (SELECT *, greatest(0, p0 + length(token) // 2 - 125) AS a FROM sp),
s1 AS (SELECT *, CASE WHEN p0 < 0 THEN 0 WHEN least(n, a + 250) - a < 250 THEN greatest(0, least(n, a + 250) - 250) ELSE a END AS lo, CASE
  WHEN p0 < 0 THEN least(n, 250) ELSE least(n, a + 250) END AS hi FROM s0),
cut AS (SELECT query_nr, gutenberg_id, {squeeze("substr(text, lo + 1, hi - lo)")} AS snippet, CASE WHEN p0 < 0 THEN '1' ELSE
  CAST(1 + lo - length(replace(substr(text, 1, lo), chr(10), '')) AS VARCHAR) END AS start_line FROM s1),
sn AS MATERIALIZED (SELECT l.query_nr, l.model, l.rank, l.gutenberg_id, l.score, coalesce(snippet, '') AS snippet, coalesce(start_line,
  '') AS start_line
  FROM lists l LEFT JOIN cut c ON l.query_nr = c.query_nr AND l.gutenberg_id = c.gutenberg_id)"""
TSV = SNIPPETS + """,
tsv AS MATERIALIZED (SELECT query_nr, model, rank AS line, concat_ws(chr(9), CAST(rank AS VARCHAR), gutenberg_id, printf('%.6f', score), translate(snippet, chr(9) || chr(10) || chr(13), '   '), start_line) AS value FROM sn)"""
BROKEN = TSV + """,
bt AS (SELECT query_nr, model, line, CASE WHEN line = 2 AND query_nr = 2 AND model = 'bm25' THEN 'two' || chr(9) || 'columns'
  WHEN line = 3 AND query_nr = 2 AND model = 'vsm' THEN 'x' || chr(9) || '1' || chr(9) || '0.5' || chr(9) || chr(9)
  WHEN line = 2 AND query_nr = 4 AND model = 'bm25' THEN '2' || chr(9) || '1' || chr(9) || '99999.0' || chr(9) || chr(9)
  WHEN line = 3 AND query_nr = 4 AND model = 'vsm' THEN '7' || chr(9) || '1' || chr(9) || 'none' || chr(9) || chr(9) ELSE value END AS value
  FROM tsv),
bc AS (SELECT *, string_split(value, chr(9)) AS c FROM bt),
bw AS (SELECT query_nr, model, line, TRY_CAST(c[1] AS BIGINT) AS rk, TRY_CAST(c[3] AS DOUBLE) AS sc, c[2] AS id FROM bc WHERE len(c) = 5),
bg AS (SELECT *, lag(sc) OVER w AS b, lag(id) OVER w AS ib FROM bw WHERE rk IS NOT NULL AND sc IS NOT NULL WINDOW w AS (PARTITION BY query_nr, model ORDER BY line))"""
JUDGED = LISTS + """,
j AS MATERIALIZED (SELECT l.query_nr, l.model, l.rank, l.gutenberg_id, CASE WHEN n_chars >= 6000 THEN 1 WHEN n_chars >= 3000 THEN 2
  ELSE 0 END AS label
  FROM lists l LEFT JOIN (SELECT gutenberg_id, sum(n_chars) AS n_chars FROM documents GROUP BY 1) d USING (gutenberg_id) WHERE l.rank <= 10),
jr AS (SELECT *, row_number() OVER o AS i, count(*) FILTER (WHERE label = 1) OVER (o ROWS UNBOUNDED PRECEDING) AS rel, CASE label
  WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS gain FROM j WINDOW o AS (PARTITION BY query_nr, model ORDER BY rank)),
jg AS (SELECT *, row_number() OVER (PARTITION BY query_nr, model ORDER BY gain DESC, rank) AS k FROM jr),
m AS MATERIALIZED (SELECT query_nr, model, sum(CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 10 AS p_at_k,
  sum(gain) / 10 AS p_at_k_partial, sum(CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS p, sum(gain) / count(*) AS p_partial,
  coalesce(avg(CAST(rel AS DOUBLE) / i) FILTER (WHERE label = 1), 0) AS ap, CASE
  WHEN sum(gain) > 0 THEN sum(gain / log2(i + 1)) / sum(gain / log2(k + 1)) ELSE 0 END AS ndcg, count(*) AS result_count FROM jg GROUP BY 1, 2),
mr AS (SELECT query_nr, model, round(p_at_k, 4) AS p_at_k, round(p_at_k_partial, 4) AS p_at_k_partial, round(ap, 4) AS ap, round(ndcg, 4) AS ndcg, result_count FROM m)"""
GRID = "(SELECT query_nr, unnest(['structured', 'vsm', 'bm25']) AS model FROM q)"


OVERLAP = (
    LISTS
    + """, ls AS (SELECT query_nr, model, list(gutenberg_id) FILTER (WHERE rank <= 10) AS ids, count(*) AS n FROM lists GROUP BY 1, 2),
pg AS (SELECT query_nr, p[1] AS model_1, p[2] AS model_2 FROM (SELECT query_nr, unnest([['structured', 'vsm'], ['structured', 'bm25'], ['vsm',
  'bm25']]) AS p FROM q)),
pj AS (SELECT pg.*, coalesce(a.n, 0) AS result_count_1, coalesce(b.n, 0) AS result_count_2, coalesce(a.ids, []) AS x, coalesce(b.ids, []) AS y FROM pg
  LEFT JOIN ls a ON a.query_nr = pg.query_nr AND a.model = model_1 LEFT JOIN ls b ON b.query_nr = pg.query_nr AND b.model = model_2),
oj AS (SELECT query_nr, model_1, model_2, result_count_1, result_count_2, CAST(len(list_intersect(x, y)) AS INTEGER) AS overlap,
  CASE WHEN len(x) + len(y) > 0 THEN round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) ELSE 0.0::DOUBLE END AS jaccard FROM pj)"""
)
SPREAD = (
    LISTS
    + f""", qs AS (SELECT query_nr, model, count(*) AS c, min(score) AS a, quantile_cont(score, 0.25) AS b, quantile_cont(score, 0.5) AS d,
  quantile_cont(score, 0.75) AS e, max(score) AS f FROM lists GROUP BY 1, 2),
sq2 AS (SELECT query_nr, model, coalesce(c, 0) AS result_count, round(a, 8) AS min_score, round(b, 8) AS p25, round(d, 8) AS median, round(e, 8) AS p75, round(f, 8) AS max_score FROM {GRID} LEFT JOIN qs USING (query_nr, model))"""
)


def one(wanted: dict[int, str], n: int) -> dict[int, str]:
    return {n: wanted[n]}


GAPS = "WITH p AS (SELECT DISTINCT term, docid FROM postings WHERE term IS NOT NULL AND docid IS NOT NULL AND tf >= 1), gp AS (SELECT term, docid, docid - lag(docid, 1, 0) OVER (PARTITION BY term ORDER BY docid) AS gap FROM p) "
SQL = {
    "preprocess_tokens": f"WITH {DOCS}, {LINES}, {TOKS} SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM tk",
    "query_tokens": f"WITH t AS (SELECT rec_id, {tokens("coalesce(title, '')")} AS toks FROM metadata) SELECT rec_id, array_to_string(list_sort(list_concat(toks, list_filter(list_distinct(list_transform(toks, lambda x: strip_accents(x))), lambda x: NOT list_contains(toks, x)))), ' ') AS tokens FROM t",
    "accent_alias": f"WITH {INDEX} SELECT term, strip_accents(term) AS alias FROM lex WHERE strip_accents(term) <> term",
    "boilerplate_strip": f"WITH {DOCS}, {LINES} SELECT doc_id, content FROM bodies",
    "phrase_normalize": f"WITH {DOCS} SELECT doc_id, {phrase_form('text')} AS phrase FROM docs",
    "metadata_normalize": f"SELECT rec_id, {metadata_form('title')} AS title, {metadata_form('authors')} AS authors FROM metadata",
    "sorted_token_key": f"SELECT rec_id, {key(tokens("coalesce(authors, '')"))} AS author_key FROM metadata",
    "term_freq": f"WITH {DOCS}, {LINES}, {TOKS}, {TF} SELECT * FROM tfs",
    "alias_postings": f"WITH {DOCS}, {LINES}, {TOKS}, {TF} SELECT gutenberg_id, strip_accents(term) AS term, tf FROM tfs WHERE strip_accents(term) <> term",
    "lexicon_df": f"WITH {INDEX} SELECT * FROM lex",
    "doc_len": f"WITH {INDEX} SELECT * FROM dl",
    "corpus_globals": f"WITH {INDEX} SELECT n, round(avgdl, 6) AS avgdl, 1.2::DOUBLE AS k1, 0.75::DOUBLE AS b FROM g",
    "idf_both": f"WITH {INDEX} SELECT term, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf_cosine, round(CASE WHEN n - df + 0.5 > 0 THEN greatest(ln((n - df + 0.5) / (df + 0.5)), 0) ELSE 0 END, 6) AS idf_bm25 FROM lex CROSS JOIN g",
    "doc_norm": f"WITH {INDEX}, {NORMS} SELECT gutenberg_id, round(coalesce(doc_norm, 0), 6) AS doc_norm FROM dl LEFT JOIN norms USING (gutenberg_id)",
    "dense_docid": "SELECT gutenberg_id, row_number() OVER (ORDER BY gutenberg_id) - 1 AS docid FROM (SELECT DISTINCT gutenberg_id FROM documents WHERE gutenberg_id IS NOT NULL)",
    "postings_gaps": GAPS + "SELECT * FROM gp",
    "gap_roundtrip": GAPS + "SELECT term, docid, docid AS restored FROM gp",
    "index_validate": "SELECT 'df' AS failure, 'x' AS of WHERE false",
    "bm25_batch": bm25(EVALUATED),
    "bm25_single": bm25(one(EVALUATED, 2)),
    "bm25_stopword_empty": bm25(one(EVALUATED, 1)),
    "vsm_batch": vsm(EVALUATED),
    "vsm_single": vsm(one(EVALUATED, 4)),
    "vsm_abort": vsm(one(EVALUATED, 5)),
    "structured_batch": catalogue_search(CATALOGUE),
    "structured_title": catalogue_search(one(CATALOGUE, 1)),
    "structured_author": catalogue_search(one(CATALOGUE, 7)),
    "structured_other_fallback": catalogue_search(one(CATALOGUE, 4)),
    "phrase_trigger": f"WITH {INDEX}, {asked(EVALUATED)} SELECT query_nr, fallback FROM trig",
    "bm25_fallback": fallback(EVALUATED),
    "phrase_rerank": fallback(one(EVALUATED, 5)),
    "phrase_full_scan": fallback(one(EVALUATED, 6)),
    "best_token": BEST + " SELECT * FROM best",
    "snippets": SNIPPETS + " SELECT query_nr, model, rank, gutenberg_id, snippet, start_line FROM sn",
    "results_topk": LISTS + " SELECT * FROM lists WHERE rank <= 10",
    "tsv_rows": TSV + " SELECT * FROM tsv",
    "tsv_validate": BROKEN
    + f""" SELECT query_nr, model, CAST(line AS BIGINT) AS line, 'columns' AS failure FROM bc WHERE len(c) <> 5 UNION ALL SELECT query_nr,
  model, line, 'rank not a number' FROM bw WHERE rk IS NULL
 UNION ALL SELECT query_nr, model, line, 'rank not in sequence' FROM bw WHERE rk <> line UNION ALL SELECT query_nr, model, line,
  'score not a number' FROM bw WHERE rk IS NOT NULL AND sc IS NULL
 UNION ALL SELECT query_nr, model, line, 'score rises' FROM bg WHERE sc > b UNION ALL SELECT query_nr, model, line, 'ids of a tie descend'
  FROM bg WHERE sc = b AND id < ib
 UNION ALL SELECT query_nr, model, count(*), 'too many rows' FROM bt GROUP BY 1, 2 HAVING count(*) > 100
 UNION ALL SELECT query_nr, model, 0, 'missing' FROM {GRID} WHERE (query_nr, model) NOT IN (SELECT query_nr, model FROM bt)""",
    "determinism_diff": "SELECT 1::INTEGER AS query_nr, '' AS model, '' AS gutenberg_id, 0.0::DOUBLE AS score, 1::INTEGER AS rank, '' AS only_in WHERE false",
    "metadata_dedup": f"WITH {MERGED} SELECT * FROM merged",
    "has_text_flag": f"WITH {MERGED} SELECT gutenberg_id, has_text FROM flagged",
    "missing_ids": f"WITH {MERGED} SELECT gutenberg_id FROM flagged WHERE has_text = 0",
    "dataset_report": f"WITH {MERGED} SELECT (SELECT count(*) FROM metadata) AS raw_rows, count(*) AS unique_ids, CAST(sum(has_text) AS BIGINT) AS with_text, CAST(count(*) - sum(has_text) AS BIGINT) AS missing_text FROM flagged",
    "precision_at_k": JUDGED + " SELECT query_nr, model, round(p_at_k, 6) AS p_at_k, round(p_at_k_partial, 6) AS p_at_k_partial FROM m",
    "judge_precision": JUDGED + " SELECT query_nr, model, round(p, 6) AS p, round(p_partial, 6) AS p_partial FROM m",
    "average_precision": JUDGED + " SELECT query_nr, model, round(ap, 6) AS ap FROM m",
    "ndcg": JUDGED + " SELECT query_nr, model, round(ndcg, 6) AS ndcg FROM m",
    "metrics_report": JUDGED + " SELECT * FROM mr",
    "metrics_summary": JUDGED + " SELECT model, round(avg(p_at_k), 4) AS mean_p_at_k, round(avg(p_at_k_partial), 4) AS mean_p_at_k_partial, round(avg(ap), 4) AS mean_ap, round(avg(ndcg), 4) AS mean_ndcg, count(*) AS queries_judged FROM mr GROUP BY 1",
    "overlap_jaccard": OVERLAP + " SELECT * FROM oj",
    "score_quantiles": SPREAD + " SELECT * FROM sq2",
    "build_report": f"""WITH {INDEX}, t AS (SELECT sum(strlen(text)) AS b FROM documents WHERE gutenberg_id IS NOT NULL)
SELECT 'N' AS metric, CAST(n AS VARCHAR) AS value, '' AS unit FROM g UNION ALL SELECT 'avgdl', printf('%.2f', avgdl), '' FROM g
UNION ALL SELECT 'final_vocab_size', CAST(count(*) AS VARCHAR), '' FROM lex UNION ALL SELECT 'total_text_bytes_read', printf('%.2f', b / 1e6), 'MB' FROM t""",
    "latency_report": LISTS
    + """ SELECT raw AS query, model, CAST(CAST(CAST(max(score) / 8 AS DECIMAL(20, 9)) AS DECIMAL(20, 2)) AS VARCHAR) AS elapsed_ms,
  count(*) AS topk, count(*) AS candidates_scored, contains(raw, '"') AS phrase_fallback
FROM lists JOIN q USING (query_nr) GROUP BY raw, model""",
    "report_metrics": JUDGED
    + """ SELECT CAST(query_nr AS VARCHAR) AS query_nr, raw AS query_text, model, printf('%.4f', p_at_k) AS "P@10", printf('%.4f',
  p_at_k_partial) AS "P@10_partial",
printf('%.4f', ap) AS "AP@10", printf('%.4f', ndcg) AS "NDCG@10", result_count FROM mr JOIN q USING (query_nr)""",
    "report_overlap": OVERLAP + " SELECT CAST(query_nr AS VARCHAR) AS query_nr, model_1 || '_vs_' || model_2 AS pair, overlap AS overlap_top10, printf('%.4f', jaccard) AS jaccard_top10 FROM oj",
    "report_scores": SPREAD
    + " SELECT CAST(query_nr AS VARCHAR) AS query_nr, model, result_count, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN CAST(CAST(CAST({c} AS DECIMAL(20, 9)) AS DECIMAL(20, 6)) AS VARCHAR) END AS {c}" for c in ("min_score", "p25", "median", "p75", "max_score"))
    + " FROM sq2",
    "catalogue_csv": "SELECT "
    + ", ".join(f"nullif({c}, '') AS {c}" for c in ("gutenberg_id", "title", "authors", "language", "bookshelf", "rights"))
    + " FROM metadata",
    "index_reload": f"""WITH {INDEX}, {NORMS} SELECT gutenberg_id, doc_len, round(coalesce(doc_norm, 0), 6) AS doc_norm, n, round(avgdl, 6) AS avgdl
FROM dl LEFT JOIN norms USING (gutenberg_id) CROSS JOIN g""",
    "byte_lists": """SELECT term, docid, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT DISTINCT term, docid, passage_no, tf, block_no FROM postings
WHERE term IS NOT NULL AND docid IS NOT NULL AND tf >= 1) GROUP BY 1, 2""",
    "lists_reread": SNIPPETS
    + """ SELECT CAST(query_nr AS VARCHAR) AS query_nr, model, rank, gutenberg_id, round(score, 6) AS score, translate(snippet, chr(9) || chr(10) || chr(13), '   ') AS snippet, start_line
FROM sn""",
    "judgments_reread": JUDGED + " SELECT CAST(query_nr AS VARCHAR) AS query_nr, model, rank, gutenberg_id, label FROM j",
    "results_titles": LISTS
    + """ SELECT query_nr, model, rank, gutenberg_id, coalesce(title, '') AS title, coalesce(authors, '') AS authors
FROM lists LEFT JOIN merged USING (gutenberg_id) WHERE rank <= 10""",
    "bm25_no_scan": f"WITH {INDEX}, {asked(EVALUATED)}, {BM25}, {PHRASE}, refused AS (SELECT * FROM fb WHERE query_nr IN (SELECT query_nr FROM bm)) "
    + ranked("refused", columns="query_nr, gutenberg_id, score, fallback_used"),
    "phrase_caps": f"WITH {INDEX}, {asked(EVALUATED)}, {BM25}, {PHRASE.replace('r <= 5000', 'r <= 20').replace('r <= 200', 'r <= 30')} SELECT * FROM fb",
    "empty_queries": f"WITH {MERGED}, {structured(EMPTY)} SELECT query_nr, 'structured' AS model, gutenberg_id, score FROM st",
}
