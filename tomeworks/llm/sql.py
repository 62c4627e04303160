"""Queries of this package as SQL, where SQL can state them.

Words and plain forms are stated for the characters that stand in the driver's tables (marks, widths,
ligatures, invisible signs, blanks, letters of three scripts); the code works for all of Unicode.
"""

from __future__ import annotations

import unicodedata

from tomeworks.llm.codepoints import CYRILLIC_AS_LATIN, GREEK_AS_CYRILLIC, GREEK_AS_LATIN

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
BLANKS = "\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}"
GROUPS = {c: unicodedata.normalize("NFKC", c) for c in map(chr, (*range(0x2160, 0x2180), 0x2116, *range(0xFB00, 0xFB07)))}  # letter groups in one sign
W = "\\p{L}\\p{N}\\p{Mn}\\p{Mc}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plain(x: str) -> str:
    """One width, no invisible signs, groups in letters, one kind of blank, marks joined."""
    for a, b in GROUPS.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace(regexp_replace({x}, '\\p{{Cf}}', '', 'g'), '[{BLANKS}]', ' ', 'g')"
    return f"nfc_normalize(translate({x}, {lit(WIDE)}, {lit(NARROW)}))"


def folded(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def latin(x: str) -> str:
    """Letters that look Latin as Latin ones, for texts that are Latin as a whole."""
    return f"translate({x}, {lit(''.join(CYRILLIC_AS_LATIN))}, {lit(''.join(CYRILLIC_AS_LATIN.values()))})"


def unmarked(x: str) -> str:
    """Without tags and bracketed numbers."""
    return f"regexp_replace(regexp_replace({x}, '<[\\p{{L}}/!?][^<>]*>', ' ', 'g'), '\\[[0-9]+\\]|\\{{[0-9]+\\}}', ' ', 'g')"


def joined(x: str) -> str:
    """Hyphens within words and at line ends, and apostrophes, left out; the rest of a line that a split word ran into stays a line."""
    x = f"regexp_replace({x}, '([{W}])[-‐‑]\\s*[\\r\\n]\\s*([{W}][{W}''’‘ʼ‐‑-]*)', '\\1\\2' || chr(10), 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([{W}])[-‐‑]([{W}])', '\\1\\2', 'g')"
    return f"regexp_replace({x}, '[''’‘ʼ]', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({joined(x)}, '[{W}]+')"


def grams(table: str, n: int) -> str:
    """id, pos, gram of a table of words in lists (id, w)."""
    return f"SELECT id, unnest(range(1, len(w) - {n - 2})) AS pos, array_to_string(w[unnest(range(1, len(w) - {n - 2})):unnest(range(1, len(w) - {n - 2})) + {n - 1}], ' ') AS gram FROM {table} WHERE len(w) >= {n}"


# Problem 3: flags. A word with letters of two scripts, or one that looks like the script of the text around it.
MIXED = "|".join(f"\\p{{{a}}}\\p{{L}}*\\p{{{b}}}" for a in ("Latin", "Cyrillic", "Greek") for b in ("Latin", "Cyrillic", "Greek") if a != b)
ODD = f"\\p{{Cf}}|[{BLANKS}\\x{{FF01}}-\\x{{FF5E}}\\x{{FB00}}-\\x{{FB06}}\\x{{2160}}-\\x{{217F}}\\x{{2116}}\\x{{300}}-\\x{{36F}}]"


def count(x: str, kind: str) -> str:
    return f"length(regexp_replace({x}, '[^{kind}]', '', 'g'))"


P3_FOUND = f"""WITH c AS (SELECT rec_id, unnest(['title', 'authors']) AS field_name, unnest([title, authors]) AS x FROM metadata),
s AS (SELECT rec_id, field_name, x, {count("x", "\\p{Latin}")} AS lat, {count("x", "\\p{Cyrillic}")} AS cyr, {count("x", "\\p{Greek}")} AS gre
  FROM c WHERE x IS NOT NULL)
SELECT DISTINCT rec_id, field_name FROM s WHERE regexp_matches(x, '{ODD}') OR regexp_matches(x, '{MIXED}')
 OR (lat > cyr + gre AND len(list_filter(regexp_extract_all(x, '\\p{{L}}+'), lambda w: regexp_full_match(w, '[{"".join(CYRILLIC_AS_LATIN)}]+')
  OR regexp_full_match(w, '[{"".join(GREEK_AS_LATIN)}]+'))) > 0)
 OR (cyr > lat AND len(list_filter(regexp_extract_all(x, '\\p{{L}}+'), lambda w: regexp_full_match(w, '[{"".join(CYRILLIC_AS_LATIN.values())}]+')
  AND NOT regexp_full_match(w, '[IVXLCDM]+'))) > 0)
 OR (gre > lat AND len(list_filter(regexp_extract_all(x, '\\p{{L}}+'), lambda w: regexp_full_match(w, '[{"".join(GREEK_AS_LATIN.values())}]+') AND NOT regexp_full_match(w, '[IVXLCDM]+'))) > 0)"""



def reverse(table: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for a, b in table.items():
        out.setdefault(b, a)
    return out


# Letters of each script that look like one of another, by the script they are to be written in.
SCRIPTS = ("Latin", "Cyrillic", "Greek")
TWINS = {
    "Latin": CYRILLIC_AS_LATIN | GREEK_AS_LATIN,
    "Cyrillic": reverse(CYRILLIC_AS_LATIN) | GREEK_AS_CYRILLIC,
    "Greek": reverse(GREEK_AS_LATIN) | reverse(GREEK_AS_CYRILLIC)
}
DOUBTFUL = "".join(sorted(set("".join(c for t in TWINS.values() for c in t))))


def weight(x: str, script: str, sure: int) -> str:
    """Letters of a script that look like no other's count most."""
    return f"({sure} * ({count(x, f'\\p{{{script}}}')} - {count(x, ''.join(c for c in DOUBTFUL if of_script(c) == script))}) + {count(x, f'\\p{{{script}}}')})"


def of_script(c: str) -> str:
    return "Greek" if "\u0370" <= c < "\u0400" else "Cyrillic" if "\u0400" <= c < "\u0530" else "Latin"


def largest(of: dict[str, str]) -> str:
    """The name with the largest expression, the first on a tie."""
    a, b, c = SCRIPTS
    return f"CASE WHEN {of[a]} >= {of[b]} AND {of[a]} >= {of[c]} THEN '{a}' WHEN {of[b]} >= {of[c]} THEN '{b}' ELSE '{c}' END"


def written(w: str, script: str) -> str:
    return "CASE " + script + " " + " ".join(
        f"WHEN '{s}' THEN translate({w}, {lit(''.join(TWINS[s]))}, {lit(''.join(TWINS[s].values()))})" for s in SCRIPTS
    ) + " END"


def one_script(x: str, home: str) -> str:
    """Words of several scripts in the one that tells most, words that only look like another script in that of the text."""
    kinds = " + ".join(f"regexp_matches(w, '\\p{{{s}}}')::INT" for s in SCRIPTS)
    target = largest(
        {s: f"({weight('w', s, 1_000_000)} + CASE WHEN {home} = '{s}' AND regexp_matches(w, '\\p{{{s}}}') THEN 500000 ELSE 0 END)" for s in SCRIPTS}
    )
    stray = f"NOT regexp_matches(w, '[^{DOUBTFUL}]') AND NOT regexp_full_match(w, '[IVXLCDM]+')"
    word = f"CASE WHEN NOT regexp_matches(w, '^\\p{{L}}') THEN w WHEN {kinds} > 1 THEN {written('w', f'({target})')} WHEN {stray} THEN {written('w', home)} ELSE w END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: {word}), '')"


P3_PLAIN = f"""WITH p AS (SELECT rec_id, {plain("title")} AS t, {plain("authors")} AS a FROM metadata),
h AS MATERIALIZED (SELECT *, {largest({s: weight("t", s, 1000) for s in SCRIPTS})} AS ht,
  {largest({s: weight("a", s, 1000) for s in SCRIPTS})} AS ha FROM p),
f AS MATERIALIZED ({P3_FOUND})
SELECT rec_id, {one_script("t", "ht")} AS title, {one_script("a", "ha")} AS authors, (rec_id, 'title') IN (SELECT rec_id, field_name FROM f) AS title_odd, (rec_id, 'authors') IN (SELECT rec_id, field_name FROM f) AS authors_odd FROM h"""

# Problem 8: runs of 12 words of an item.
P8_PAIRS = f"""WITH dw AS MATERIALIZED (SELECT doc_id AS id, {words(unmarked(folded(latin(plain("text")))))} AS w FROM documents),
iw AS MATERIALIZED (SELECT item_id AS id, {words(unmarked(folded(latin(plain("passage")))))} AS w FROM eval_items),
dg AS MATERIALIZED ({grams("dw", 12)}), ig AS MATERIALIZED ({grams("iw", 12)}),
hits AS (SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (gram))"""

# Problem 10: words in runs seen before, by place.
P10_WORDS = f"""WITH lines AS (SELECT doc_id, regexp_split_to_array({joined(folded(plain("text")))}, '[\\r\\n\\v\\f]') AS l FROM documents),
ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM lines),
lw AS (SELECT doc_id, line_no, regexp_extract_all(line, '[{W}]+') AS v FROM ln),
ww AS (SELECT doc_id, line_no, unnest(v) AS word, generate_subscripts(v, 1) AS k FROM lw WHERE len(v) > 0),
w AS MATERIALIZED (SELECT doc_id, line_no, word, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) AS pos FROM ww)"""


def repeated(n: int) -> str:
    """doc_id, pos of the words in a run of n words seen before."""
    run = " || ' ' || ".join(f"lead(word, {k}) OVER o" if k else "word" for k in range(n))
    return f"""g{n} AS (SELECT doc_id, pos, {run} AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
d{n} AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) > 1 AS again FROM g{n} WHERE gram IS NOT NULL),
r{n} AS MATERIALIZED (SELECT w.doc_id, w.pos, coalesce(max(again::INT) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) AS hit FROM w LEFT JOIN d{n} USING (doc_id, pos))"""


def shares(n: int) -> str:
    return f"round(sum(length(word)) FILTER (WHERE r{n}.hit = 1) / sum(length(word)), 9)"


P10_SHARES = ", ".join(
    [
        f"coalesce(round(avg(r{n}.hit), 9), 0) AS rep_words_{n}" for n in (4, 6, 10)
    ] + [f"coalesce({shares(n)}, 0) AS rep_chars_{n}" for n in (4, 6, 10)]
)
P10_JOINS = " ".join(f"JOIN r{n} USING (doc_id, pos)" for n in (4, 6, 10))
P10_REPETITION = f"""{P10_WORDS}, {", ".join(map(repeated, (4, 6, 10)))},
ls AS (SELECT doc_id, line_no, string_agg(word, ' ' ORDER BY pos) AS line, sum(length(word)) AS chars FROM w GROUP BY 1, 2),
lr AS (SELECT doc_id, chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) > 1 AS again FROM ls),
lt AS (SELECT doc_id, round(coalesce(sum(chars) FILTER (WHERE again), 0) / sum(chars), 9) AS rep_lines FROM lr GROUP BY 1),
wt AS (SELECT doc_id, count(*) AS n_words, {P10_SHARES} FROM w {P10_JOINS} GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words,
  {", ".join(f"coalesce(rep_{k}_{n}, 0) AS rep_{k}_{n}" for k in ("words", "chars") for n in (4, 6, 10))}, coalesce(rep_lines, 0) AS rep_lines
FROM documents d LEFT JOIN wt USING (doc_id) LEFT JOIN lt USING (doc_id)"""

# Problem 9, sized in characters.
P9_PLAN = """WITH sized AS MATERIALIZED (SELECT doc_id, nullif(lower(trim(source)), '') AS source, coalesce(n_chars, 0) AS tokens,
  ('0x' || substr(md5(doc_id::VARCHAR || ':1'), 1, 15))::BIGINT AS h FROM documents),
have AS (SELECT source, sum(tokens) AS available, count(*) AS n_docs FROM sized WHERE source IS NOT NULL GROUP BY 1),
want AS (SELECT lower(trim(source)) AS source, sum(coalesce(target_share, 0)) AS target_share, max(coalesce(max_repeats, 1)) AS max_repeats
  FROM mix_targets GROUP BY 1),
b AS (SELECT * FROM want JOIN have USING (source) WHERE available > 0 AND target_share > 0 AND max_repeats > 0),
o AS (SELECT sum(target_share) AS s, min(max_repeats * available / target_share) AS m FROM b),
pl AS (SELECT source, available, max_repeats, target_share / s AS share, target_share / s * (m * s) AS demand FROM b CROSS JOIN o),
me AS (SELECT max(demand / available) AS e, sum(share * (demand / available)) AS mean FROM pl),
p AS MATERIALIZED (SELECT pl.*, 0.8::DOUBLE * (mean - demand / available) / e AS tilt FROM pl CROSS JOIN me),
st AS (SELECT doc_id, source, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY h, doc_id) - tokens AS start FROM sized
  WHERE source IS NOT NULL),
ep AS (SELECT st.*, p.*, unnest(range(0, greatest(least(ceil(demand / available)::BIGINT, max_repeats), 1))) AS epoch FROM st
  JOIN p ON st.source = p.source),
u AS (SELECT *, (start + epoch * available) / demand AS u FROM ep),
mx AS MATERIALIZED (SELECT round(2 * u / (1 + tilt + sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * u, 0))), 9) AS position, source, doc_id, epoch::INTEGER AS epoch, tokens FROM u WHERE u < 1)"""
P9_SHARES = f"""{P9_PLAN}, got AS (SELECT source, sum(tokens) AS mixed_tokens, count(*) AS mixed_docs, max(epoch) + 1 AS repeats FROM mx GROUP BY 1),
all_docs AS (SELECT coalesce(source, '(none)') AS source, sum(tokens) AS available_tokens, count(*) AS n_docs FROM sized GROUP BY 1)
SELECT coalesce(w.source, a.source) AS source, coalesce(target_share, 0) AS target_share, coalesce(max_repeats, 0) AS max_repeats,
  coalesce(n_docs, 0) AS n_docs, coalesce(available_tokens, 0)::BIGINT AS available_tokens,
  coalesce(mixed_docs, 0) AS mixed_docs, coalesce(mixed_tokens, 0)::BIGINT AS mixed_tokens, coalesce(repeats, 0)::INTEGER AS repeats,
  coalesce(round(mixed_tokens / (SELECT sum(mixed_tokens) FROM got), 6), 0) AS share
FROM want w FULL JOIN all_docs a ON w.source = a.source LEFT JOIN got g ON g.source = coalesce(w.source, a.source)"""

SQL = {
    "p3_found": P3_FOUND,
    "p3_plain": P3_PLAIN,
    "p8_found": P8_PAIRS + " SELECT * FROM hits",
    "p8_items": P8_PAIRS + " SELECT DISTINCT i.item_id, suite, coalesce(n, 0) AS n_documents FROM eval_items i LEFT JOIN (SELECT item_id, count(*) AS n FROM hits GROUP BY 1) h USING (item_id)",
    "p9_mixture_chars": P9_PLAN + " SELECT position, source, doc_id, epoch, tokens AS n_chars FROM mx",
    "p9_shares_chars": P9_SHARES,
    "p10_found": f"{P10_WORDS}, {repeated(6)} SELECT doc_id FROM r6 GROUP BY 1 HAVING avg(hit) >= 0.3",
    "p10_repetition": P10_REPETITION,
}
