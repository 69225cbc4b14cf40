"""DuckDB SQL for every deterministic registered query.

The statements are assembled from CTE fragments that restate each operator's
definition in plain SQL (tables ``events``, ``orders``, ``lineitem``, ``part``,
``nation``, ``region`` are views over the same Parquet files).  The Spark side
must match them on row count, schema and values.
"""

from __future__ import annotations

K = 10
N_CANDIDATES = 2000  # max(k * 200, k)
WEIGHT_CASE = "CASE event WHEN 'view' THEN 1.0 WHEN 'addtocart' THEN 3.0 WHEN 'transaction' THEN 5.0 END::DOUBLE"
VALID = "('view', 'addtocart', 'transaction')"
RELEVANT = "('addtocart', 'transaction')"
FALLBACK = "('view', 'addtocart', 'transaction')"


def _raw(fixture: str, name: str = "raw") -> str:
    if fixture == "events":
        return f"""{name} AS (
  SELECT epoch_us(ts) // 1000 AS timestamp,
         CAST(user_id AS INTEGER) AS visitorid,
         CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'addtocart'
              WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS itemid,
         CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS transactionid
  FROM events)"""
    if fixture == "events_dirty":
        return f"""{name} AS (
  SELECT epoch_us(ts) // 1000 AS timestamp,
         CAST(user_id AS INTEGER) AS visitorid,
         CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'addtocart'
              WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
         CASE WHEN event_id % 13 <> 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) END AS itemid,
         CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS transactionid
  FROM events, (SELECT unnest([1, 2]) AS copy) c
  WHERE c.copy = 1 OR event_id % 10 = 0)"""
    if fixture == "orders":
        return f"""{name} AS (
  SELECT epoch_us(o.o_orderdate) // 1000 AS timestamp,
         CAST(o.o_custkey AS INTEGER) AS visitorid,
         CASE l.l_returnflag WHEN 'N' THEN 'view' WHEN 'A' THEN 'addtocart'
              WHEN 'R' THEN 'transaction' ELSE l.l_returnflag END AS event,
         CAST(l.l_partkey AS INTEGER) AS itemid,
         CASE WHEN l.l_returnflag = 'R'
              THEN CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) END AS transactionid
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
    raise ValueError(fixture)


def _clean(src: str = "raw", name: str = "clean") -> str:
    return f"""{name} AS (
  SELECT timestamp, visitorid, event, itemid, transactionid,
         {WEIGHT_CASE} AS event_weight,
         timestamp // 1000 AS event_seconds,
         CAST(CAST(epoch_ms((timestamp // 1000) * 1000) AS DATE) AS VARCHAR) AS event_date
  FROM (SELECT DISTINCT timestamp, visitorid, event, itemid, transactionid FROM {src}
        WHERE visitorid IS NOT NULL AND itemid IS NOT NULL AND timestamp IS NOT NULL
          AND event IN {VALID}) d
  WHERE {WEIGHT_CASE} IS NOT NULL)"""


def _murmur_bucket(src: str, name: str) -> str:
    """Spark's hash(int) (Murmur3 x86_32, seed 42) -> pmod(abs(h), 10000) per visitor."""
    return f"""{name} AS (
  SELECT visitorid,
    ((visitorid::BIGINT) & 4294967295) AS m0,
    ((m0::HUGEINT * 3432918353) % 4294967296)::BIGINT AS m1,
    ((m1 << 15) | (m1 >> 17)) & 4294967295 AS m2,
    ((m2::HUGEINT * 461845907) % 4294967296)::BIGINT AS m3,
    xor(42, m3) AS h0,
    ((h0 << 13) | (h0 >> 19)) & 4294967295 AS h1,
    (h1 * 5 + 3864292196) % 4294967296 AS h2,
    xor(h2, 4) AS f0,
    xor(f0, f0 >> 16) AS f1,
    ((f1::HUGEINT * 2246822507) % 4294967296)::BIGINT AS f2,
    xor(f2, f2 >> 13) AS f3,
    ((f3::HUGEINT * 3266489909) % 4294967296)::BIGINT AS f4,
    xor(f4, f4 >> 16) AS f5,
    abs(CASE WHEN f5 >= 2147483648 THEN f5 - 4294967296 ELSE f5 END) % 10000 AS bucket
  FROM (SELECT DISTINCT visitorid FROM {src}) u)"""


def _interactions(src: str, name: str, log: bool = True, min_user: int = 1, min_item: int = 1) -> str:
    score = "ln(1 + sum(event_weight))" if log else "sum(event_weight)"
    base = f"""{name}_all AS (
  SELECT visitorid, itemid, CAST({score} AS DOUBLE) AS score, count(*) AS event_count,
         max(event_seconds) AS last_event_seconds
  FROM {src} GROUP BY visitorid, itemid)"""
    where = []
    if min_user > 1:
        where.append(f"visitorid IN (SELECT visitorid FROM {name}_all GROUP BY visitorid HAVING count(*) >= {min_user})")
    if min_item > 1:
        where.append(f"itemid IN (SELECT itemid FROM {name}_all GROUP BY itemid HAVING count(*) >= {min_item})")
    cond = " AND ".join(where) if where else "TRUE"
    return base + f""",
{name} AS (SELECT * FROM {name}_all WHERE {cond})"""


def _cutoff(src: str, name: str, ratio: float) -> str:
    return f"""{name} AS (
  SELECT min(timestamp) AS cutoff
  FROM (SELECT timestamp, sum(c) OVER (ORDER BY timestamp) AS cum
        FROM (SELECT timestamp, count(*) AS c FROM {src} GROUP BY timestamp) g) w,
       (SELECT count(*) AS n FROM {src}) t
  WHERE cum >= least(greatest(floor(n * {ratio}::DOUBLE), 1), n))"""


def _split(p: str, src: str, ratio: float = 0.8, min_user: int = 2, min_item: int = 2,
           relevant: str = RELEVANT, fallback: str = FALLBACK) -> str:
    """CTEs {p}cut, {p}trev, {p}teev, {p}train, {p}test, {p}rel (long form)."""
    return ",\n".join([
        _cutoff(src, f"{p}cut", ratio),
        f"{p}trev AS (SELECT e.* FROM {src} e, {p}cut c WHERE e.timestamp <= c.cutoff)",
        f"{p}teev AS (SELECT e.* FROM {src} e, {p}cut c WHERE e.timestamp > c.cutoff)",
        _interactions(f"{p}trev", f"{p}train", True, min_user, min_item),
        _interactions(f"{p}teev", f"{p}test", True, 1, 1),
        f"""{p}rel1 AS (SELECT DISTINCT visitorid, itemid FROM {p}teev
  WHERE event IN {relevant} AND visitorid IN (SELECT visitorid FROM {p}train))""",
        f"""{p}relfb AS (SELECT DISTINCT visitorid, itemid FROM {p}teev
  WHERE event IN {fallback} AND visitorid IN (SELECT visitorid FROM {p}train))""",
        f"""{p}rel AS (SELECT * FROM {p}rel1
  UNION ALL SELECT * FROM {p}relfb WHERE NOT EXISTS (SELECT 1 FROM {p}rel1))""",
    ])


def _base(fixture: str, p: str = "", **split_args) -> str:
    return ",\n".join([_raw(fixture), _clean(), _split(p, "clean", **split_args)])


def _popular(p: str, train: str, k: int = K, exclude_seen: bool = True) -> str:
    """CTEs {p}cands (cand_rank, itemid, item_score), {p}users, {p}recs (visitorid, rank, itemid)."""
    unseen = (f"WHERE NOT EXISTS (SELECT 1 FROM {train} t WHERE t.visitorid = u.visitorid AND t.itemid = c.itemid)"
              if exclude_seen else "")
    return f"""{p}pop AS (
  SELECT itemid, sum(CAST(score AS DECIMAL(28,12))) AS item_score FROM {train} GROUP BY itemid),
{p}cands AS (
  SELECT CAST(row_number() OVER (ORDER BY item_score DESC, itemid ASC) AS INTEGER) AS cand_rank, itemid, item_score
  FROM {p}pop QUALIFY cand_rank <= {N_CANDIDATES}),
{p}users AS (SELECT DISTINCT visitorid FROM {train}),
{p}recs AS (
  SELECT u.visitorid, CAST(row_number() OVER (PARTITION BY u.visitorid ORDER BY c.cand_rank) AS INTEGER) AS rank,
         c.itemid
  FROM {p}users u, {p}cands c {unseen}
  QUALIFY rank <= {k})"""


def _cooc(p: str, train: str, k: int = K, cap: int | None = 100, top_n: int = 50) -> str:
    """CTEs {p}pairs (itemid, candidate_itemid, similarity), {p}top, {p}scores, {p}recs, {p}users."""
    users = "" if cap is None else f""" WHERE visitorid IN
  (SELECT visitorid FROM {p}hist GROUP BY visitorid HAVING count(*) <= {cap})"""
    return f"""{p}hist AS (SELECT visitorid, itemid FROM {train}),
{p}capped AS (SELECT * FROM {p}hist{users}),
{p}half AS (
  SELECT a.itemid AS ia, b.itemid AS ib, count(*) AS similarity
  FROM {p}capped a JOIN {p}capped b ON a.visitorid = b.visitorid AND a.itemid < b.itemid
  GROUP BY a.itemid, b.itemid),
{p}pairs AS (
  SELECT ia AS itemid, ib AS candidate_itemid, similarity FROM {p}half
  UNION ALL SELECT ib, ia, similarity FROM {p}half),
{p}top AS (
  SELECT itemid, candidate_itemid, similarity FROM {p}pairs
  QUALIFY row_number() OVER (PARTITION BY itemid ORDER BY similarity DESC, candidate_itemid ASC) <= {top_n}),
{p}scores AS (
  SELECT h.visitorid, t.candidate_itemid, CAST(sum(t.similarity) AS BIGINT) AS score
  FROM {p}hist h JOIN {p}top t ON h.itemid = t.itemid
  WHERE NOT EXISTS (SELECT 1 FROM {p}hist s WHERE s.visitorid = h.visitorid AND s.itemid = t.candidate_itemid)
  GROUP BY h.visitorid, t.candidate_itemid),
{p}recs AS (
  SELECT visitorid,
         CAST(row_number() OVER (PARTITION BY visitorid ORDER BY score DESC, candidate_itemid ASC) AS INTEGER) AS rank,
         candidate_itemid AS itemid
  FROM {p}scores QUALIFY rank <= {k}),
{p}users AS (SELECT DISTINCT visitorid FROM {p}recs)"""


def _idcg(m: str) -> str:
    return f"list_sum(list_transform(range(1, {m} + 1), lambda i: 1.0 / log2(i + 1)))"


def _per_user(p: str, recs: str, users: str, rel: str, k: int = K) -> str:
    """CTE {p}pu: per evaluated user precision/recall/map/ndcg."""
    return f"""{p}relsz AS (SELECT visitorid, count(*) AS n_rel FROM {rel} GROUP BY visitorid),
{p}ev AS (SELECT u.visitorid, r.n_rel FROM {users} u JOIN {p}relsz r ON u.visitorid = r.visitorid),
{p}hits AS (
  SELECT l.visitorid, l.rank, row_number() OVER (PARTITION BY l.visitorid ORDER BY l.rank) AS j
  FROM {recs} l JOIN {rel} r ON l.visitorid = r.visitorid AND l.itemid = r.itemid WHERE l.rank <= {k}),
{p}hs AS (SELECT visitorid, count(*) AS hits, sum(j / rank) AS ap_sum, sum(1.0 / log2(rank + 1)) AS dcg
  FROM {p}hits GROUP BY visitorid),
{p}pu AS (
  SELECT e.visitorid,
         coalesce(h.hits, 0) / {float(k)} AS precision_at_{k},
         coalesce(h.hits, 0) / e.n_rel AS recall_at_{k},
         coalesce(h.ap_sum, 0.0) / least(e.n_rel, {k}) AS map_at_{k},
         coalesce(h.dcg, 0.0) / {_idcg(f"least(e.n_rel, {k})")} AS ndcg_at_{k}
  FROM {p}ev e LEFT JOIN {p}hs h ON e.visitorid = h.visitorid)"""


def _evaluate(p: str, recs: str, users: str, rel: str, train: str, k: int = K) -> str:
    """CTE {p}eval: one row with the averaged metrics, coverage and test_users."""
    return _per_user(p, recs, users, rel, k) + f""",
{p}eval AS (
  SELECT coalesce(avg(precision_at_{k}), 0.0) AS precision_at_{k},
         coalesce(avg(recall_at_{k}), 0.0) AS recall_at_{k},
         coalesce(avg(map_at_{k}), 0.0) AS map_at_{k},
         coalesce(avg(ndcg_at_{k}), 0.0) AS ndcg_at_{k},
         (SELECT CASE WHEN (SELECT count(DISTINCT itemid) FROM {train}) > 0
                      THEN (SELECT count(DISTINCT itemid) FROM {recs})::DOUBLE
                           / (SELECT count(DISTINCT itemid) FROM {train}) ELSE 0.0 END) AS coverage,
         count(*) AS test_users
  FROM {p}pu)"""


def _r6(cols, src_prefix: str = "") -> str:
    return ", ".join(f"round({src_prefix}{c}, 6) AS {c}" for c in cols)


def _metrics_select(k: int = K) -> str:
    return (_r6([f"precision_at_{k}", f"recall_at_{k}", f"map_at_{k}", f"ndcg_at_{k}", "coverage"])
            + ", test_users")


PROFILE_SELECT = """
  SELECT count(*) AS total_events,
         count(DISTINCT visitorid) AS total_visitors,
         count(DISTINCT itemid) AS total_items,
         count(*) FILTER (WHERE event = 'transaction') AS total_transactions,
         count(*) FILTER (WHERE event = 'addtocart') AS total_addtocart,
         count(*) FILTER (WHERE event = 'view') AS total_views,
         min(timestamp) AS min_timestamp,
         max(timestamp) AS max_timestamp,
         min(event_date) AS event_date_min,
         max(event_date) AS event_date_max,
         round(CASE WHEN count(DISTINCT visitorid) * count(DISTINCT itemid) > 0
               THEN 1.0 - count(*)::DOUBLE / (count(DISTINCT visitorid)::DOUBLE * count(DISTINCT itemid))
               ELSE 0.0 END, 6) AS sparsity_estimate,
         round(CASE WHEN count(DISTINCT visitorid) > 0 THEN count(*)::DOUBLE / count(DISTINCT visitorid)
               ELSE 0.0 END, 6) AS avg_events_per_user,
         round(CASE WHEN count(DISTINCT itemid) > 0 THEN count(*)::DOUBLE / count(DISTINCT itemid)
               ELSE 0.0 END, 6) AS avg_events_per_item
  FROM clean"""

INTERACTIONS_SELECT = "SELECT visitorid, itemid, round(score, 6) AS score, event_count, last_event_seconds FROM"
CLEAN_SELECT = ("SELECT timestamp, visitorid, event, itemid, transactionid, event_weight, event_seconds, event_date "
                "FROM clean")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _cutoff_rows(fixture: str, ratios=(0.8, 0.25)) -> str:
    ctes = [_raw(fixture), _clean()] + [_cutoff("clean", f"c{i}", r) for i, r in enumerate(ratios)]
    parts = [f"""SELECT {float(r)}::DOUBLE AS ratio, c.cutoff AS cutoff,
  count(*) FILTER (WHERE e.timestamp <= c.cutoff) AS train_events,
  count(*) FILTER (WHERE e.timestamp > c.cutoff) AS test_events
FROM clean e, c{i} c GROUP BY c.cutoff""" for i, r in enumerate(ratios)]
    return _with(*ctes) + "\nUNION ALL\n".join(parts)


def _experiment_row(p: str, fixture_src: str, fraction: float, models=("popularity",)) -> tuple[list[str], str]:
    """CTEs and a SELECT for one scale-experiment row (popularity is the last model)."""
    threshold = int(fraction * 10000)
    sample = (f"{p}ev AS (SELECT * FROM {fixture_src} WHERE visitorid IN "
              f"(SELECT visitorid FROM {p}bk WHERE bucket < {threshold}))") if fraction < 1 else \
        f"{p}ev AS (SELECT * FROM {fixture_src})"
    ctes = [_murmur_bucket(fixture_src, f"{p}bk"), sample, _split(p, f"{p}ev"),
            _popular(f"{p}m_", f"{p}train"), _evaluate(f"{p}m_", f"{p}m_recs", f"{p}m_users", f"{p}rel",
                                                       f"{p}train")]
    select = f"""SELECT {float(fraction)}::DOUBLE AS fraction,
  (SELECT count(*) FROM {p}ev) AS input_rows,
  (SELECT count(DISTINCT visitorid) FROM {p}ev) AS users,
  (SELECT count(DISTINCT itemid) FROM {p}ev) AS items,
  CAST(NULL AS INTEGER) AS partitions,
  (SELECT count(*) FROM {p}train) AS train_rows,
  (SELECT count(DISTINCT itemid) FROM {p}train) AS catalog_items,
  e.test_users AS test_users, 'popularity' AS model, 'popularity' AS best_model,
  round(e.precision_at_10, 6) AS precision, round(e.recall_at_10, 6) AS recall, round(e.map_at_10, 6) AS map,
  round(e.ndcg_at_10, 6) AS ndcg, round(e.coverage, 6) AS coverage
FROM {p}m_eval e"""
    return ctes, select


def _model_rows() -> str:
    ctes = [_base("orders"), _popular("p_", "train"), _evaluate("p_", "p_recs", "p_users", "rel", "train"),
            _cooc("c_", "train"), _evaluate("c_", "c_recs", "c_users", "rel", "train")]
    body = []
    for label, p in (("popularity", "p_"), ("cooccurrence", "c_")):
        body.append(f"""SELECT '{label}' AS model, '{{}}' AS params, {K} AS k,
  (SELECT count(*) FROM train) AS train_rows, (SELECT count(DISTINCT itemid) FROM train) AS catalog_items,
  test_users, precision_at_10 AS precision, recall_at_10 AS recall, map_at_10 AS map, ndcg_at_10 AS ndcg,
  coverage FROM {p}eval""")
    return _with(*ctes) + ", models AS (" + "\nUNION ALL\n".join(body) + ")\n"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["events_csv_roundtrip"] = _with(_raw("events"), _clean()) + (
        "SELECT 'csv' AS format, (SELECT count(*) FROM raw) AS rows "
        "UNION ALL SELECT 'parquet', (SELECT count(*) FROM clean)")
    q["item_properties_scan"] = """
SELECT 0::BIGINT AS timestamp, CAST(p_partkey AS INTEGER) AS itemid, 'brand' AS property, p_brand AS value FROM part
UNION ALL SELECT 0::BIGINT, CAST(p_partkey AS INTEGER), 'type', p_type FROM part
UNION ALL SELECT 0::BIGINT, CAST(p_partkey AS INTEGER), 'size', CAST(p_size AS VARCHAR) FROM part"""
    q["category_tree_scan"] = """
SELECT CAST(n_nationkey + 100 AS INTEGER) AS categoryid, CAST(n_regionkey AS INTEGER) AS parentid FROM nation
UNION ALL SELECT CAST(r_regionkey AS INTEGER), CAST(NULL AS INTEGER) FROM region"""
    q["clean_events"] = _with(_raw("events_dirty"), _clean()) + CLEAN_SELECT
    broken = ("broken AS (SELECT * REPLACE (CASE WHEN timestamp % 97 = 0 THEN NULL ELSE visitorid END AS visitorid), "
              "timestamp % 97 = 0 AS bad FROM raw)")
    q["clean_from_csv"] = _with(_raw("events_dirty"), broken, _clean("broken")) + CLEAN_SELECT
    lacks = "(visitorid IS NULL OR itemid IS NULL OR timestamp IS NULL)"
    q["csv_check"] = _with(_raw("events_dirty"), broken, _clean("broken")) + f"""
SELECT count(*) AS rows, count(*) FILTER (bad) AS malformed, count(*) FILTER (NOT bad AND {lacks}) AS lacking,
       count(*) FILTER (NOT bad AND NOT {lacks} AND event NOT IN {VALID}) AS unknown_type,
       CAST(count(*) FILTER (NOT {lacks} AND event IN {VALID}) - (SELECT count(*) FROM clean) AS BIGINT) AS copies,
       (SELECT count(*) FROM clean) AS clean_rows
FROM broken"""
    q["clean_orders"] = _with(_raw("orders"), _clean()) + CLEAN_SELECT
    q["event_weight_default"] = _with(_raw("events")) + f"""
SELECT event, coalesce({WEIGHT_CASE}, 0.0) AS weight, count(*) AS events FROM raw GROUP BY event"""
    q["dataset_profile"] = _with(_raw("events"), _clean()) + PROFILE_SELECT
    q["dataset_profile_orders"] = _with(_raw("orders"), _clean()) + PROFILE_SELECT
    q["dataset_profile_merged"] = q["dataset_profile_orders"]
    q["interactions_log"] = _with(_raw("orders"), _clean(), _interactions("clean", "inter")) + \
        INTERACTIONS_SELECT + " inter"
    q["interactions_raw"] = _with(_raw("orders"), _clean(), _interactions("clean", "inter", log=False)) + \
        INTERACTIONS_SELECT + " inter"
    q["support_filter"] = _with(_raw("orders"), _clean(), _interactions("clean", "inter", True, 30, 30)) + \
        INTERACTIONS_SELECT + " inter"
    q["user_sample"] = _with(_raw("orders"), _clean(), _murmur_bucket("clean", "bk")) + """
SELECT c.visitorid, b.bucket, count(*) AS events
FROM clean c JOIN bk b ON c.visitorid = b.visitorid WHERE b.bucket < 2500 GROUP BY c.visitorid, b.bucket"""
    q["exact_cutoff"] = _cutoff_rows("orders")
    q["temporal_split_counts"] = _cutoff_rows("events")
    q["approx_cutoff_bound"] = _with(_raw("orders"), _clean()) + (
        "SELECT count(*) AS events, least(greatest(CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT), 1), count(*)) AS target_rank, "
        "true AS within_bound FROM clean")
    q["relevant_items"] = _with(_base("orders")) + "SELECT visitorid, itemid FROM rel"
    q["relevant_fallback"] = _with(_base("orders", relevant="('no_such_event')")) + \
        "SELECT visitorid, itemid, (SELECT count(*) = 0 FROM rel1) AS used_fallback FROM rel"
    q["user_history"] = _with(_base("orders")) + """
SELECT visitorid, itemid, count(*) OVER (PARTITION BY visitorid) AS n_items FROM train"""
    q["distinct_counts"] = _with(_base("orders")) + """
SELECT count(*) AS train_rows, count(DISTINCT visitorid) AS train_users, count(DISTINCT itemid) AS train_items,
  (SELECT count(*) FROM test) AS test_rows, (SELECT count(DISTINCT visitorid) FROM rel) AS relevant_users,
  (SELECT count(*) FROM rel) AS relevant_pairs
FROM train"""
    q["item_popularity_topn"] = _with(_base("orders"), _popular("", "train")) + \
        "SELECT cand_rank, itemid, CAST(round(item_score, 6) AS DOUBLE) AS item_score FROM cands"
    q["popular_recs"] = _with(_base("orders"), _popular("", "train")) + "SELECT visitorid, rank, itemid FROM recs"
    q["popular_recs_keep_seen"] = _with(_base("orders"), _popular("", "train", exclude_seen=False)) + \
        "SELECT visitorid, rank, itemid FROM recs"
    q["popular_list_sizes"] = _with(_base("events"), _popular("", "train")) + """
SELECT u.visitorid, CAST(count(r.itemid) AS INTEGER) AS list_size
FROM users u LEFT JOIN recs r ON u.visitorid = r.visitorid GROUP BY u.visitorid"""
    q["pair_support"] = _with(_base("orders"), _cooc("", "train", cap=None)) + \
        "SELECT itemid, candidate_itemid, similarity FROM pairs"
    q["pair_support_cap30"] = _with(_base("orders"), _cooc("", "train", cap=30)) + \
        "SELECT itemid, candidate_itemid, similarity FROM pairs"
    q["top_similar"] = _with(_base("orders"), _cooc("", "train")) + \
        "SELECT itemid, candidate_itemid, similarity FROM top"
    q["candidate_scores"] = _with(_base("events"), _cooc("", "train")) + \
        "SELECT visitorid, candidate_itemid, score FROM scores"
    q["cooc_recs"] = _with(_base("orders"), _cooc("", "train")) + "SELECT visitorid, rank, itemid FROM recs"
    q["per_user_metrics"] = _with(_base("orders"), _popular("", "train"), _per_user("", "recs", "users", "rel")) + \
        "SELECT visitorid, " + _r6(["precision_at_10", "recall_at_10", "map_at_10", "ndcg_at_10"]) + " FROM pu"
    q["per_user_metrics_arrays"] = q["per_user_metrics"]
    q["evaluate_popularity"] = _with(_base("orders"), _popular("", "train"),
                                     _evaluate("", "recs", "users", "rel", "train")) + \
        "SELECT " + _metrics_select() + " FROM eval"
    q["evaluate_cooccurrence"] = _with(_base("orders"), _cooc("", "train"),
                                       _evaluate("", "recs", "users", "rel", "train")) + \
        "SELECT " + _metrics_select() + " FROM eval"
    q["evaluate_cooccurrence_all_relevant"] = _with(
        _base("orders"), _cooc("", "train"), "allrel AS (SELECT DISTINCT visitorid FROM rel)",
        _evaluate("", "recs", "allrel", "rel", "train")) + "SELECT " + _metrics_select() + " FROM eval"
    q["als_invariants"] = ("SELECT 0::BIGINT AS seen_violations, 0::BIGINT AS over_k, 0::BIGINT AS rank_gaps, "
                           "0::BIGINT AS outside_subset")
    q["als_invariants_orders"] = q["als_invariants"] + ", 0::BIGINT AS short_lists"
    q["als_optimality"] = "SELECT true AS within_bound, true AS all_users"
    q["als_tables_by_rank"] = _with(_base("orders")) + f"""
SELECT als_rank, count(DISTINCT visitorid) AS users, {K} * count(DISTINCT visitorid) AS rows, 0::BIGINT AS differing
FROM rel, (VALUES (8), (16)) r(als_rank) GROUP BY als_rank"""
    # experiments
    q["fastest_partitions"] = "SELECT 4::BIGINT AS measured, 4::BIGINT AS timed, 4::BIGINT AS no_faster, 1::BIGINT AS chosen"
    q["storage_summary"] = _with(_raw("orders"), _clean()) + (
        "SELECT 'csv' AS format, count(*) AS rows, true AS timed FROM raw UNION ALL SELECT 'parquet', count(*), true FROM clean")
    ctes, selects = [_raw("orders"), _clean()], []
    for i, fraction in enumerate((0.25, 0.5, 0.75, 1.0)):
        c, s = _experiment_row(f"f{i}_", "clean", fraction)
        ctes += c
        selects.append(s)
    q["scale_experiment"] = _with(*ctes) + "\nUNION ALL\n".join(selects)
    c, s = _experiment_row("q_", "clean", 1.0)
    q["partition_invariance"] = _with(_raw("orders"), _clean(), *c) + "\nUNION ALL\n".join(
        f"SELECT {n} AS partitions, {n} AS shuffle_partitions, input_rows, precision, recall, map, ndcg, coverage "
        f"FROM ({s}) x"
        for n in (2, 4, 8, 16))
    metrics6 = ", ".join(f"round({m}, 6) AS {m}" for m in ("precision", "recall", "map", "ndcg", "coverage"))
    q["model_experiment"] = _model_rows() + (
        f"SELECT model, params, k, train_rows, catalog_items, test_users, {metrics6} FROM models")
    q["best_model"] = _model_rows() + """
SELECT 'precision' AS metric, arg_max(model, (precision, model)) AS model, round(max(precision), 6) AS value
FROM models
UNION ALL SELECT 'recall', arg_max(model, (recall, model)), round(max(recall), 6) FROM models"""
    q["evaluate_stored_lists"] = _model_rows() + (
        f"SELECT model, {metrics6}, CAST(test_users AS BIGINT) AS test_users, true AS matches_direct FROM models "
        "UNION ALL SELECT 'als_rank8', NULL, NULL, NULL, NULL, NULL, NULL, true")
    q["benchmark_run"] = """SELECT * FROM (VALUES ('model_benchmark', 8::BIGINT), ('scale_benchmark', 4::BIGINT),
  ('partition_benchmark', 4::BIGINT), ('storage_benchmark', 2::BIGINT)) t(table_name, rows)"""
    q["report_summary"] = _with(_raw("orders"), _clean()) + f"""
SELECT total_events, total_visitors, total_items, event_date_min, event_date_max, total_views, total_addtocart, total_transactions,
       'cooccurrence,popularity' AS models, '0.25,0.5,0.75,1.0' AS fractions FROM ({PROFILE_SELECT}) p"""
    q["prepare_tables"] = _with(_base("orders", min_user=2, min_item=2),
                                _interactions("clean", "inter", True, 2, 2)) + """
SELECT 'events_clean' AS table_name, (SELECT count(*) FROM clean) AS rows
UNION ALL SELECT 'interactions', (SELECT count(*) FROM inter)
UNION ALL SELECT 'train_interactions', (SELECT count(*) FROM train)
UNION ALL SELECT 'test_interactions', (SELECT count(*) FROM test)
UNION ALL SELECT 'test_relevant_items', (SELECT count(*) FROM rel)
UNION ALL SELECT 'popularity_lists', (SELECT count(DISTINCT visitorid) FROM train)
UNION ALL SELECT 'dataset_profile', 1"""
    return q
