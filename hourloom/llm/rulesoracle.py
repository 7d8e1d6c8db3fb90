"""DuckDB SQL of the quality rules query, from the rules' definitions."""

from __future__ import annotations

from hourloom.llm import rules as r

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _length_of(kept: str) -> str:
    return f"length(regexp_replace(t, '[^{kept}]', '', 'g'))"


def quality_rules_sql() -> str:
    common = ", ".join(f"('{w.decode()}')" for w in r.WORDS)
    blank = r"\x20\x09-\x0D"
    # classes in order: blank, a-z, A-Z, digit, punctuation, other ASCII, beyond ASCII
    known = [_length_of(blank), _length_of("a-z"), _length_of("A-Z"), _length_of("0-9"), _length_of(r".,;:!?''\"()\-")]
    ascii_all = _length_of(r"\x00-\x7F")
    classes = [*known, f"{ascii_all} - ({' + '.join(known)})", f"length(t) - {ascii_all}"]
    bins = ", ".join(f"{{'g': 'c', 'k': '{i}', 'n': {c}}}" for i, c in enumerate(classes))
    failed = f"n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.MAX_REPEAT_PERCENT} * n_words"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '(null)') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{blank}]+') AS ws, regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '[^{blank}]+') AS lw,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{blank}]')) AS lines FROM d),
win AS (SELECT doc_id, s, array_to_string(ws[s : s + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS s FROM w)),
twice AS (SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([s, s + 1, s + 2]) FROM twice) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, t, lw, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS wc, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, ({failed}) AS base_failed FROM b),
cls AS (SELECT doc_id, lang, base_failed, n_words, n_symbols, unnest([{bins}], recursive := true) FROM f),
cw(k) AS (VALUES {common}),
hit AS (SELECT doc_id, x AS k, count(*) AS n FROM (SELECT doc_id, unnest(lw) AS x FROM f) WHERE x IN (SELECT k FROM cw) GROUP BY doc_id, x),
oth AS (SELECT f.doc_id, '' AS k, n_words - coalesce(sum(hit.n), 0) AS n FROM f LEFT JOIN hit ON hit.doc_id = f.doc_id GROUP BY f.doc_id, n_words),
wrd AS (SELECT h.doc_id, f.lang, f.base_failed, f.n_words, f.n_symbols, 'w' AS g, h.k, h.n FROM (SELECT * FROM hit UNION ALL SELECT * FROM oth) h JOIN f ON f.doc_id = h.doc_id),
al AS (SELECT * FROM cls UNION ALL SELECT * FROM wrd),
docs_of AS (SELECT lang, count(*) AS c FROM f WHERE NOT base_failed AND {r.SYMBOL_WORDS} * n_symbols <= n_words GROUP BY lang),
ref AS (SELECT lang, g, k, sum(n) AS n FROM al WHERE NOT base_failed AND {r.SYMBOL_WORDS} * n_symbols <= n_words GROUP BY lang, g, k),
q AS (SELECT lang, g, k, n::DOUBLE / greatest(sum(n) OVER (PARTITION BY lang, g), 1) AS q FROM ref),
p AS (SELECT doc_id, lang, g, k, n::DOUBLE / greatest(sum(n) OVER (PARTITION BY doc_id, g), 1) AS p FROM al),
dg AS (SELECT DISTINCT doc_id, lang, g FROM al),
pq AS (SELECT dg.doc_id, dg.g, coalesce(p.p, 0) AS p, q.q AS q FROM dg JOIN q ON q.lang = dg.lang AND q.g = dg.g LEFT JOIN p ON p.doc_id = dg.doc_id AND p.g = q.g AND p.k = q.k
       UNION ALL
       SELECT p.doc_id, p.g, p.p, 0.0 FROM p JOIN docs_of USING (lang) ANTI JOIN q ON q.lang = p.lang AND q.g = p.g AND q.k = p.k),
js AS (SELECT doc_id, g, CASE WHEN sum(p) > 0 THEN sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) ELSE 0 END AS v
       FROM pq GROUP BY doc_id, g),
o AS (SELECT f.doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      CASE WHEN c >= {r.REFERENCE_DOCS} AND n_words >= {r.CHAR_WORDS} THEN a.v END AS cd, CASE WHEN c >= {r.REFERENCE_DOCS} AND n_words >= {r.COMMON_WORDS} THEN b.v END AS wd
      FROM f LEFT JOIN docs_of ON docs_of.lang = f.lang LEFT JOIN js a ON a.doc_id = f.doc_id AND a.g = 'c' LEFT JOIN js b ON b.doc_id = f.doc_id AND b.g = 'w')
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 0) <= {r.MAX_CHAR_DISTANCE} AND coalesce(wd, 0) <= {r.MAX_WORD_DISTANCE} AS kept,
       round(cd, 9) AS char_distance, round(wd, 9) AS word_distance
FROM o
"""
