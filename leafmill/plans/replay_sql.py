"""The replay of corrections as one recursive query: a step applies the next event of every issue."""

from __future__ import annotations

#: A row of ``st`` is an article after n events of its issue; the row without an id carries the issue's counters and starts the
#: articles that moves make. ``replayed`` has the articles after all events.
REPLAY_SQL = r"""
cl0 AS (SELECT article_id, issue, f.page AS page, f.region_ids AS rs, i AS fi FROM (SELECT article_id, issue, fragments, unnest(range(1, len(fragments) + 1)) AS i, unnest(fragments) AS f FROM articles WHERE issue IS NOT NULL)),
cl1 AS (SELECT article_id, issue, page || ':' || unnest(rs) AS frag, fi, unnest(range(1, len(rs) + 1)) AS ri FROM cl0),
cl2 AS (SELECT article_id, issue, frag, min(fi * 1000000 + ri) AS pos FROM cl1 GROUP BY ALL),
held AS (SELECT article_id, issue, list(frag ORDER BY pos) AS frags FROM cl2 GROUP BY ALL),
reg AS (SELECT issue, page || ':' || region_order AS frag, max(text) AS region_text FROM layout_regions WHERE issue IS NOT NULL GROUP BY ALL),
page_keys AS (SELECT issue, list(frag) AS region_keys FROM reg GROUP BY ALL),
ev AS (SELECT a.*, a.issue AS e_issue, coalesce(k.region_keys, []) AS region_keys, r.frag IS NOT NULL AS is_region, r.region_text, row_number() OVER (PARTITION BY a.issue ORDER BY event_id) AS n FROM (SELECT DISTINCT * FROM annotations WHERE issue IS NOT NULL) a LEFT JOIN reg r ON r.issue = a.issue AND r.frag = a.frag LEFT JOIN page_keys k ON k.issue = a.issue),
start AS (
  SELECT a.issue, 0 AS n, a.article_id AS id, row_number() OVER (PARTITION BY a.issue ORDER BY length(a.article_id), a.article_id) AS ord, coalesce(h.frags, []) AS frags, a.art_type, a.title, CAST(NULL AS VARCHAR) AS subtitle, a.author, a.pages,
    CAST(NULL AS VARCHAR) AS override, CAST([] AS VARCHAR[]) AS users, 0 AS n_changes, '' AS last_mod, CAST(NULL AS VARCHAR) AS verified_by, CAST(NULL AS VARCHAR) AS verified_at,
    0 AS made, 0 AS added, CAST(MAP {} AS MAP(VARCHAR, VARCHAR)) AS edits, CAST(MAP {} AS MAP(VARCHAR, VARCHAR)) AS roles
  FROM articles a LEFT JOIN held h ON h.article_id = a.article_id AND h.issue = a.issue WHERE a.issue IS NOT NULL
  UNION ALL SELECT DISTINCT issue, 0, NULL, 0, [], NULL, NULL, NULL, NULL, [], NULL, [], 0, '', NULL, NULL, 0, 0, MAP {}, MAP {} FROM (SELECT issue FROM articles UNION SELECT issue FROM annotations) WHERE issue IS NOT NULL
),
st AS (
  SELECT * FROM start
  UNION ALL
  SELECT issue, n, CASE WHEN fresh THEN issue || '_u' || CASE WHEN made < 999 THEN lpad(CAST(made + 1 AS VARCHAR), 3, '0') ELSE CAST(made + 1 AS VARCHAR) END ELSE id END,
    CASE WHEN fresh THEN top + 1 ELSE ord END,
    CASE WHEN fresh THEN [frag] WHEN id IS NULL THEN frags
      WHEN act = 'set_frag_order' AND id = article_id THEN list_concat(list_filter(frag_order, lambda k: list_contains(frags, k)), list_filter(frags, lambda k: NOT list_contains(frag_order, k)))
      WHEN moves THEN CASE WHEN id = to_id AND NOT creates THEN list_concat(list_concat(list_filter(rest[1:cutoff], lambda k: true), [frag]), rest[cutoff + 1:]) ELSE rest END
      WHEN act = 'frag_furniture' AND ord = owner THEN list_concat(frags[1:list_position(frags, frag) - 1], frags[list_position(frags, frag) + 1:])
      WHEN act = 'add_manual' AND id = article_id THEN list_concat(frags, ['m:' || (added + 1)])
      WHEN merges AND id = into_id THEN list_concat(frags, source) WHEN merges AND id = article_id THEN [] ELSE frags END,
    CASE WHEN fresh THEN 'story' WHEN act = 'set_meta' AND id = article_id AND e_type IS NOT NULL THEN nullif(e_type, '') ELSE art_type END,
    CASE WHEN fresh THEN NULL WHEN act = 'set_meta' AND id = article_id AND e_title IS NOT NULL THEN nullif(e_title, '') WHEN roled AND frag_role = 'title' THEN nullif(said, '') ELSE title END,
    CASE WHEN fresh THEN NULL WHEN roled AND frag_role = 'subtitle' THEN nullif(said, '') ELSE subtitle END,
    CASE WHEN fresh THEN NULL WHEN act = 'set_meta' AND id = article_id AND e_author IS NOT NULL THEN nullif(e_author, '') WHEN roled AND frag_role = 'author' THEN nullif(said, '') ELSE author END,
    pages, CASE WHEN act = 'set_text' AND id = article_id THEN coalesce(e_text, '') ELSE override END,
    CASE WHEN touched AND user_name IS NOT NULL AND NOT list_contains(users, user_name) THEN list_append(users, user_name) ELSE users END, n_changes + CAST(touched AS INTEGER), CASE WHEN touched THEN coalesce(ts, '') ELSE last_mod END,
    CASE WHEN act = 'verify' AND id = article_id THEN user_name WHEN act = 'unverify' AND id = article_id THEN NULL ELSE verified_by END,
    CASE WHEN act = 'verify' AND id = article_id THEN ts WHEN act = 'unverify' AND id = article_id THEN NULL ELSE verified_at END,
    made + CAST(creates AS INTEGER), added + CAST(adds AS INTEGER),
    CASE WHEN act = 'edit_frag_text' THEN map_concat(edits, MAP {coalesce(frag, ''): coalesce(e_text, '')}) WHEN adds THEN map_concat(edits, MAP {'m:' || (added + 1): coalesce(e_text, '')}) ELSE edits END,
    CASE WHEN act = 'set_role' AND owner IS NOT NULL THEN map_concat(roles, MAP {frag: coalesce(frag_role, '')}) ELSE roles END
  FROM (
    SELECT *, coalesce(fresh OR (id IS NOT NULL AND (
        (act IN ('set_meta', 'set_text', 'set_frag_order', 'add_manual') AND id = article_id) OR (merges AND (id = article_id OR id = into_id))
        OR (moves AND ((list_contains(frags, frag) AND id <> coalesce(to_id, '')) OR (id = to_id AND NOT creates))) OR (act IN ('frag_furniture', 'edit_frag_text', 'set_role') AND ord = owner))), false) AS touched,
      act = 'set_role' AND coalesce(ord = owner, false) AS roled,
      regexp_replace(regexp_replace(coalesce(edits[frag], CASE WHEN starts_with(frag, 'm:') THEN '' ELSE region_text END, ''), '\s+', ' ', 'g'), '^ | $', '', 'g') AS said,
      coalesce(list_position(list_transform(rest, lambda k: CASE WHEN starts_with(k, 'm:') THEN 9000000000000 ELSE CAST(split_part(k, ':', 1) AS BIGINT) * 1000000 + CASE WHEN list_contains(region_keys, k) THEN CAST(split_part(k, ':', 2) AS BIGINT) ELSE 999999 END END > place), true) - 1, len(rest)) AS cutoff
    FROM (
      SELECT *, unnest(CASE WHEN ord = 0 AND creates THEN [false, true] ELSE [false] END) AS fresh, list_filter(frags, lambda k: k <> coalesce(frag, '')) AS rest
      FROM (
        SELECT *, act = 'move_frag' AND (owner IS NOT NULL OR is_region) AS moves, act = 'move_frag' AND (owner IS NOT NULL OR is_region) AND NOT to_there AS creates,
          act = 'merge' AND art_there AND into_there AND article_id <> into_id AS merges, act = 'add_manual' AND art_there AS adds,
          CASE WHEN starts_with(frag, 'm:') THEN 9000000000000 ELSE TRY_CAST(split_part(frag, ':', 1) AS BIGINT) * 1000000 + CASE WHEN is_region THEN TRY_CAST(split_part(frag, ':', 2) AS BIGINT) ELSE 999999 END END AS place
        FROM (
          SELECT s.* EXCLUDE (n), s.n + 1 AS n, e.event_action AS act, e.article_id, e.user_name, e.ts, e.title AS e_title, e.author AS e_author, e.art_type AS e_type, e.text AS e_text, coalesce(e.frag_order, []) AS frag_order, e.frag, e.to_id, e.frag_role, e.into_id, e.is_region, e.region_text, e.region_keys,
            max(s.ord) OVER (PARTITION BY s.issue) AS top, min(CASE WHEN list_contains(s.frags, e.frag) THEN s.ord END) OVER (PARTITION BY s.issue) AS owner,
            coalesce(bool_or(s.id = e.to_id) OVER (PARTITION BY s.issue), false) AS to_there, coalesce(bool_or(s.id = e.article_id) OVER (PARTITION BY s.issue), false) AS art_there, coalesce(bool_or(s.id = e.into_id) OVER (PARTITION BY s.issue), false) AS into_there,
            max(CASE WHEN s.id = e.article_id THEN s.frags END) OVER (PARTITION BY s.issue) AS source
          FROM st s JOIN ev e ON e.e_issue = s.issue AND e.n = s.n + 1
        )
      )
    )
  )
),
fin AS (SELECT s.* FROM st s LEFT JOIN (SELECT e_issue, max(n) AS last FROM ev GROUP BY ALL) l ON l.e_issue = s.issue WHERE s.n = coalesce(l.last, 0) AND id IS NOT NULL AND (len(frags) > 0 OR coalesce(override, '') <> '')),
replayed AS (SELECT issue, ord, id AS article_id, art_type, title, subtitle, author, frags, override, edits, roles, n_changes, users,
    list_sort(list_distinct(list_filter(list_transform(frags, lambda k: TRY_CAST(split_part(k, ':', 1) AS INTEGER)), lambda p: p <> 0))) AS held_pages, pages AS machine_pages,
    CASE WHEN verified_at >= last_mod AND verified_at <> '' THEN 'verified' WHEN n_changes > 0 THEN 'modified' ELSE 'auto' END AS status, verified_by FROM fin)
"""

#: An article's cleaned text: lines are taken one after another, ``now`` being what the line before has left of the line.
CLEAN_SQL = r"""
lines AS (SELECT issue, article_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS line, len(p) AS n FROM (SELECT issue, article_id, string_split(raw, chr(10)) AS p FROM raws)),
norm AS (SELECT issue, article_id, i, n, regexp_replace(rtrim(replace(replace(replace(replace(replace(replace(replace(line, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), chr(173), ''), chr(12), ''), ' ' || chr(9) || chr(13)), '(\S)[ \t]+', '\1 ', 'g') AS line FROM lines),
walk AS (
  SELECT issue, article_id, i, n, line AS now, CAST(NULL AS VARCHAR) AS done FROM norm WHERE i = 1
  UNION ALL
  SELECT issue, article_id, i + 1, n, CASE WHEN joins THEN ltrim(substr(after, length(taken) + 1)) ELSE line END, CASE WHEN joins THEN substr(now, 1, length(now) - 1) || taken ELSE now END
  FROM (
    SELECT *, regexp_extract(after, '^[A-Za-z]+[^\sA-Za-z]*') AS taken,
      coalesce(regexp_full_match(lower(regexp_extract(now, '([A-Za-z]{2,})-$', 1) || regexp_extract(after, '^[A-Za-z]+')), '[a-z]{2,20}') AND regexp_matches(lower(regexp_extract(now, '([A-Za-z]{2,})-$', 1) || regexp_extract(after, '^[A-Za-z]+')), '[aeiouy]')
        AND regexp_matches(now, '[A-Za-z]{2,}-$') AND regexp_matches(after, '^[A-Za-z]'), false) AS joins
    FROM (SELECT w.*, x.line, ltrim(x.line) AS after FROM walk w LEFT JOIN norm x ON x.issue = w.issue AND x.article_id = w.article_id AND x.i = w.i + 1 WHERE w.i <= w.n)
  )
),
flat AS (SELECT issue, article_id, i - 1 AS i, regexp_replace(done, '^\s+|\s+$', '', 'g') AS s FROM walk WHERE i > 1),
para AS (SELECT *, sum(CASE WHEN s = '' THEN 1 ELSE 0 END) OVER (PARTITION BY issue, article_id ORDER BY i) AS p FROM flat),
paras AS (SELECT issue, article_id, p, string_agg(s, ' ' ORDER BY i) AS t FROM para WHERE s <> '' GROUP BY ALL),
cleaned AS (SELECT r.issue, r.article_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY p), '') AS text FROM raws r LEFT JOIN paras p ON p.issue = r.issue AND p.article_id = r.article_id GROUP BY ALL)
"""
