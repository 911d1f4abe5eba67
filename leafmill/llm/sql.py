"""SQL that says the same as a query of this subpackage, where SQL can."""

_OTHER = r"\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}\p{Georgian}\p{Cherokee}\p{Coptic}"
_ODD = (
    r"[\x{FF01}-\x{FF5E}\x{FFE0}-\x{FFE6}\x{FB00}-\x{FB06}]"
    r"|[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]"
    r"|[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2010}\x{2011}\x{2043}\x{FE63}]"
    r"|\p{Latin}[\x{300}-\x{36F}]*[" + _OTHER + r"]|[" + _OTHER + r"][\x{300}-\x{36F}]*\p{Latin}"
)
P1_FOUND = f"""
WITH t AS (SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS record_key, text AS t FROM documents
UNION ALL SELECT 'pilot_issues', id, magazine FROM pilot_issues)
SELECT DISTINCT source_table, record_key FROM t WHERE regexp_matches(t, '{_ODD}') OR nfc_normalize(t) <> t
"""

P6_LINE_FREQUENCY = r"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
n AS (SELECT doc_id, source, nullif(trim(regexp_replace(lower(line), '[^\p{L}]+', ' ', 'g')), '') AS h, length(line) AS c FROM lines),
d AS (SELECT doc_id, source, h, CAST(sum(c) AS BIGINT) AS c FROM n GROUP BY ALL),
f AS (SELECT source, h FROM d WHERE h IS NOT NULL GROUP BY source, h HAVING count(*) > 10),
x AS (SELECT d.doc_id, d.source, CAST(sum(c) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN f.h IS NOT NULL THEN c ELSE 0 END) AS BIGINT) AS removed_chars FROM d LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.h = f.h GROUP BY d.doc_id, d.source)
SELECT *, CASE WHEN n_chars > 0 THEN 1 - removed_chars / n_chars ELSE 1.0 END AS kept_share, CASE WHEN n_chars > 0 THEN 1 - removed_chars / n_chars ELSE 1.0 END < 0.6 AS rejected FROM x
"""

_REPEATED = r"""
WITH t AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, regexp_extract_all(lower(replace(replace(regexp_replace(coalesce(text, ''), '[-¬]\s*\n\s*', '', 'g'), '''', ''), '’', '')), '\p{L}+') AS words FROM t),
w AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM l),
g AS (SELECT doc_id, i, w, CASE WHEN lead(w, 5) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o) END AS run FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, run IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, run ORDER BY i) > 1 AS again FROM g),
m AS (SELECT doc_id, length(w) AS n, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS marked FROM r),
s AS (SELECT doc_id, sum(n * marked) / sum(n) AS share FROM m GROUP BY doc_id),
shares AS (SELECT t.doc_id, coalesce(share, 0.0) AS repeated_share FROM t LEFT JOIN s USING (doc_id))
"""
P6_FOUND = f"{_REPEATED} SELECT doc_id FROM shares WHERE repeated_share >= 0.4"
P6_REPEATED_SHARE = f"{_REPEATED} SELECT doc_id, repeated_share FROM shares"


def p2_found(classes: list[str], pairs: list[tuple[str, str]]) -> str:
    """All pairs by brute force: every run of five folded words is joined with its equals in other documents."""
    seen = "".join(c for group in classes for c in group[1:])
    first = "".join(group[0] for group in classes for _ in group[1:])
    fold = f"translate(w, '{seen}', '{first}')"
    for a, b in pairs:
        fold = f"replace({fold}, '{a}', '{b}')"
    return rf"""
WITH t AS (SELECT DISTINCT doc_id, regexp_replace(lower(replace(replace(text, '''', ''), '’', '')), '(\p{{L}}) ?[-¬] ?\s+(\p{{L}})', '\1\2', 'g') AS t FROM documents WHERE length(text) >= 300),
l AS (SELECT doc_id, list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_|]+'), lambda w: regexp_matches(w, '\p{{L}}')) AS ws FROM t),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM l),
f AS (SELECT doc_id, n, i, {fold} AS w FROM w),
g AS (SELECT doc_id, n, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS run, lead(w, 4) OVER o IS NOT NULL AS whole FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, n, i, hash(run) AS run FROM g WHERE whole),
hits AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n, a.i FROM r a JOIN r b ON a.run = b.run AND a.doc_id <> b.doc_id),
c AS (SELECT x, y, n, least(5, coalesce(lead(i) OVER (PARTITION BY x, y ORDER BY i) - i, 5)) AS words FROM hits),
cover AS (SELECT x, y FROM c GROUP BY x, y, n HAVING sum(words) >= 0.6 * n)
SELECT a.x AS doc_id_a, a.y AS doc_id_b FROM cover a JOIN cover b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y
"""
