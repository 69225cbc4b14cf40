"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op7_decontaminate"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(13, len(t)) AS n, unnest([list_slice(t, i, i + least(13, len(t)) - 1)
         FOR i IN range(1, len(t) - least(13, len(t)) + 2)]) AS w
  FROM b WHERE len(t) > 0),
sizes AS (SELECT DISTINCT n FROM g),
x AS (
  SELECT r, n, unnest(range(1, len(t) - n + 2)) AS i, t FROM d, sizes WHERE len(t) >= n),
h AS (
  SELECT r, i, x.n, item_id FROM (SELECT r, n, i, list_slice(t, i, i + n - 1) AS w FROM x) x
  JOIN g ON g.n = x.n AND g.w = x.w),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
k AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""

SQL["op9_secret_scan"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
rules(kind, place, pat, grp, least) AS (VALUES
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20),
  ('hex', 2, '[0-9a-f]{24,}', 0, 24),
  ('private', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*(-----END [A-Z ]*PRIVATE KEY-----)?', 0, 0),
  ('webtoken', 4, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 0)),
m AS (
  SELECT r, kind, place, least, string_split_regex(t, pat) AS gap, regexp_extract_all(t, pat, 0) AS hit,
         CASE WHEN grp = 2 THEN regexp_extract_all(t, pat, 2) ELSE regexp_extract_all(t, pat, 0) END AS told
  FROM d, rules WHERE regexp_matches(t, pat)),
p AS (SELECT r, kind, place, least, unnest(range(1, len(hit) + 1)) AS i, gap, hit, told FROM m),
s AS (
  SELECT r, kind, place, list_sum([length(x) FOR x IN gap[1:i]]) + coalesce(list_sum([length(x) FOR x IN hit[1:i - 1]]), 0) AS a,
         length(hit[i]) AS n FROM p WHERE length(told[i]) >= least),
j AS (SELECT r, kind, place, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS z FROM s),
o AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, place) FILTER (place < 3), '') AS base,
         string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, place) AS spans
  FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (r)
"""


def _pour(src: str, parent: str, name: str) -> str:
    """Children of ``src`` (cap, weight, above) with their budgets: the same filling rule, window by window."""
    by = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, {name}" if parent else name
    return f"""
SELECT {keys}, CASE WHEN weight <= 0 THEN 0 WHEN pot IS NULL THEN cap
       ELSE (pot.l * weight) // pot.s END AS above
FROM (SELECT *, first(CASE WHEN NOT filled AND weight > 0 THEN {{'l': l, 's': s}} END IGNORE NULLS) OVER (
        {by} ORDER BY k NULLS FIRST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pot
  FROM (SELECT *, cap * s <= l * weight AND weight > 0 AS filled
    FROM (SELECT *, above - coalesce(sum(CASE WHEN weight > 0 THEN cap ELSE 0 END) OVER (
            {by} ORDER BY k NULLS FIRST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
            sum(weight) OVER ({by} ORDER BY k NULLS FIRST, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s
      FROM (SELECT *, CAST(cap AS DOUBLE) / nullif(weight, 0) AS k FROM ({src})))))"""


def _mix_sql() -> str:
    node = "SELECT {keys}, sum(cap) AS cap, any_value({weight}) AS weight, any_value({above}) AS above FROM {of} GROUP BY {keys}"
    domain_w = "CASE domain WHEN 'web' THEN 4 WHEN 'reference' THEN 3 WHEN 'books' THEN 2 ELSE 1 END"
    lang_w = "CASE language WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"
    one = node.format(keys="domain", weight=domain_w, of="leaves", above="(SELECT t FROM total)")
    two = node.format(keys="domain, language", weight=lang_w, of="leaves JOIN b1 USING (domain)", above="b1.above")
    three = node.format(keys="domain, language, source", weight="1", of="leaves JOIN b2 USING (domain, language)", above="b2.above")
    return f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, ''))) AS row_id, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS source,
         coalesce(['web', 'reference', 'books', 'forums'][CAST(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS HUGEINT) % 4 + 1 AS BIGINT)], 'unknown') AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n
  FROM documents),
rows0 AS (SELECT * FROM rows_ WHERE n > 0),
leaves AS (SELECT domain, language, source, CAST(sum(n) AS HUGEINT) AS tokens, CAST(sum(n) * 4 AS HUGEINT) AS cap FROM rows0 GROUP BY ALL),
total AS (SELECT least(CAST(sum(tokens) * 600 // 1000 AS HUGEINT), CAST(sum(cap) AS HUGEINT)) AS t FROM leaves),
b1 AS ({_pour(one, "", "domain")}),
b2 AS ({_pour(two, "domain", "language")}),
b3 AS ({_pour(three, "domain, language", "source")}),
plan AS (SELECT domain, language, source, tokens, CAST(above // tokens AS BIGINT) AS epochs, above % tokens AS rest
  FROM leaves JOIN b3 USING (domain, language, source)),
last AS (
  SELECT *, sum(n) OVER (PARTITION BY domain, language, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM (SELECT *, md5('42:' || epochs || ':' || row_id) AS h
        FROM rows0 JOIN plan USING (domain, language, source)))
SELECT doc_id, domain, language, source, e AS epoch, CAST(n AS BIGINT) AS n_tokens
FROM (SELECT *, unnest(range(0, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS e FROM last)
"""


SQL["op3_mix_sources"] = _mix_sql()

SQL["op5_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT r, unnest([list_slice(t, i, i + 2) FOR i IN range(1, greatest(len(t) - 2, 1) + 1)]) AS g FROM w WHERE len(t) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT r, r AS x FROM w UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.x)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN reach USING (r) JOIN w o ON o.r = reach.x LEFT JOIN n ON n.r = w.r GROUP BY w.r, w.doc_id
"""


def _cluster_sql(rounds: int = 3, k: int = 16) -> str:
    ctes = [f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
            "x AS (SELECT r, unnest(range(1, 65)) AS d, unnest(v) AS x FROM kept)",
            f"""c0 AS (
  SELECT c, unnest(range(1, 65)) AS d, unnest(v) AS y
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c FROM kept) WHERE c < {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS (
  SELECT r, c, dist FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dist, c) AS place
    FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS dist FROM x JOIN c{i} USING (d) GROUP BY r, c)) WHERE place = 1)""")
        ctes.append(f"""c{i + 1} AS (
  SELECT c, d, coalesce(y1, y) AS y FROM c{i} LEFT JOIN (
    SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS y1
    FROM (SELECT c, d, sum(x) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY c, d)) USING (c, d))""")
    return f"""
WITH {", ".join(ctes)},
h AS (SELECT c, sha256(string_agg(y, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (c)
"""


SQL["op13_lookup_clusters"] = _cluster_sql()

SQL["op12_pair_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
c AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(c.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM p, c GROUP BY term),
m AS (SELECT r, doc_id, 75 + (25 * len(t) * c.n) // c.l AS m FROM d, c WHERE len(t) > 0),
b AS (
  SELECT q, any_value(item_id) AS item_id, term, count(*) AS times FROM (
    SELECT q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS q FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY q, term),
s AS (
  SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM b JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
