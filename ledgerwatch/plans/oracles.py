"""The registered queries in plain SQL, for comparison by another engine."""

from __future__ import annotations

_L1 = """l1 AS (
  SELECT event_id AS id, user_id AS account_id, user_id // 3 AS customer_id, ts, round(value * 50, 2) AS amount, 'USD' AS currency,
    event_type AS merchant, 'CP ' || json_extract_string(props, '$.k') AS counterparty,
    'N' || (json_extract_string(props, '$.k')::BIGINT % 25) AS country, event_type AS channel,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'out' ELSE 'in' END AS direction,
    CASE user_id % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 15.0::DOUBLE ELSE 25.0::DOUBLE END AS base_risk
  FROM events)"""

_L2 = """l2 AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS account_id, o_custkey AS customer_id, l_shipdate AS ts, l_extendedprice AS amount,
    s_name AS counterparty, p_brand AS merchant, CASE WHEN l_returnflag = 'R' THEN 'in' ELSE 'out' END AS direction, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""

_L4 = """a AS (
  SELECT o_orderkey AS id, o_orderkey AS transaction_id, o_custkey AS account_id, 'Rule' || (o_orderkey % 7) AS rule_id,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
    25.0::DOUBLE AS score, CASE o_orderstatus WHEN 'F' THEN 'sar' WHEN 'P' THEN 'false_positive' END AS disposition,
    CASE WHEN o_orderstatus IN ('F', 'P') THEN 'closed' ELSE 'open' END AS status, o_orderdate AS created_at,
    CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderdate + to_days((o_orderkey % 30)::INT) END AS updated_at, o_totalprice AS amount
  FROM orders)"""

_CASES = """c AS (
  SELECT account_id AS id, min(created_at) AS created_at, max(created_at) AS updated_at,
    CASE account_id % 4 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'INVESTIGATING' ELSE 'NEW' END AS status,
    CASE WHEN account_id % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS priority
  FROM a GROUP BY account_id)"""

_HITS = """w AS (
  SELECT *,
    count(*) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS velocity,
    count(*) FILTER (amount >= 7600.0::DOUBLE AND amount < 9500.0::DOUBLE)
      OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 168 HOURS PRECEDING AND CURRENT ROW) AS band,
    count(DISTINCT country) OVER (PARTITION BY customer_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS countries
  FROM l1),
h AS (
  SELECT id, account_id, 'HighValueTransaction' AS rule_id, 'high' AS severity, 25.0::DOUBLE AS d FROM w WHERE amount >= 10000
  UNION ALL SELECT id, account_id, 'RapidVelocity', 'medium', 20.0 FROM w WHERE velocity >= 5
  UNION ALL SELECT id, account_id, 'GeoMismatch', 'medium', 15.0 FROM w WHERE countries > 8
  UNION ALL SELECT id, account_id, 'StructuringSmurfing', 'high', 30.0 FROM w WHERE band >= 3
  UNION ALL SELECT id, account_id, 'SanctionsKeywordMatch', 'high', 30.0 FROM w WHERE contains(lower(counterparty), 'cp 13') OR contains(lower(counterparty), 'cp 7')
  UNION ALL SELECT id, account_id, 'HighRiskCountry', 'high', 25.0 FROM w WHERE country IN ('N1', 'N7')),
s AS (
  SELECT w.id, w.account_id, w.ts, count(h.id) AS n, least(greatest(any_value(base_risk) + coalesce(sum(d), 0), 0), 100)::DOUBLE AS risk_score
  FROM w LEFT JOIN h ON w.id = h.id GROUP BY w.id, w.account_id, w.ts),
b AS (SELECT *, CASE WHEN risk_score < 33 THEN 'low' WHEN risk_score < 66 THEN 'medium' ELSE 'high' END AS band FROM s)"""


def _rule(rule_id: str) -> str:
    return f"WITH {_L1}, {_HITS} SELECT id, account_id, rule_id, severity, d AS score_delta FROM h WHERE rule_id = '{rule_id}'"


def _v2(name: str, multipliers: dict[str, float], base: float) -> str:
    m = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in multipliers.items())
    return f"round(least(greatest({base}::DOUBLE + coalesce(sum(d * CASE severity {m} END * f), 0), 0), 100), 4)::DOUBLE AS score_{name}"


_DECAY = """CASE WHEN epoch(TIMESTAMP '{end}' - {ts}) / 3600 <= 24 THEN 1.0::DOUBLE WHEN epoch(TIMESTAMP '{end}' - {ts}) / 3600 <= 168 THEN 0.7::DOUBLE
  WHEN epoch(TIMESTAMP '{end}' - {ts}) / 3600 <= 720 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END"""

_EDGES = """e AS (
  SELECT src_type, src_id, dst_type, dst_key, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS txn_count FROM (
    SELECT 'account' AS src_type, account_id AS src_id, 'counterparty' AS dst_type, lower(trim(counterparty)) AS dst_key, ts FROM {src}
    UNION ALL SELECT 'account', account_id, 'merchant', lower(trim(merchant)), ts FROM {src}
    UNION ALL SELECT 'customer', customer_id, 'counterparty', lower(trim(counterparty)), ts FROM {src}) GROUP BY ALL)"""
_RECENT = "r AS (SELECT * FROM l2 WHERE ts >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAYS)"
_L3 = "l3 AS (SELECT * REPLACE (counterparty || ' part ' || part AS counterparty) FROM l2)"
_SUPPLY = f"{_L2}, {_RECENT}, {_EDGES.format(src='r')}, x AS (SELECT src_id AS account_id, dst_key, first_seen_at, last_seen_at, txn_count FROM e WHERE src_type = 'account' AND dst_type = 'counterparty')"
_WHOLE = f"{_L2}, {_L3}, {_EDGES.format(src='l3')}, x AS (SELECT src_id AS account_id, dst_key, first_seen_at, last_seen_at, txn_count FROM e WHERE src_type = 'account' AND dst_type = 'counterparty')"
_PROJECTED = f"{_WHOLE}, p AS (SELECT DISTINCT a.account_id AS src, b.account_id AS dst FROM x a JOIN x b ON a.dst_key = b.dst_key AND a.account_id <> b.account_id)"

_LIST = "n AS (SELECT DISTINCT lower(p_name) AS name FROM part), q(entry) AS (VALUES ('cold widgit'), ('blew rod'), ('large bolts'), ('new rink'))"

_DIRTY = """d AS (
  SELECT event_id AS i, CASE WHEN event_id % 50 = 3 THEN NULL ELSE 'ACC' || user_id END AS acct,
    CASE WHEN event_id % 70 = 5 THEN NULL WHEN event_id % 2 = 0 THEN ts ELSE ts END AS t,
    CASE WHEN event_id % 90 = 8 THEN NULL WHEN event_id % 3 = 0 THEN 1000 + event_id % 1000 + 0.5::DOUBLE ELSE event_id % 977 END AS amount,
    CASE WHEN event_id % 5 = 0 THEN 'eur' ELSE 'USD' END AS currency, event_type AS counterparty,
    CASE event_id % 5 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 15.0 WHEN 2 THEN 25.0 WHEN 3 THEN 7.5 ELSE 10.0 END AS base_risk
  FROM events),
k AS (
  SELECT *, CASE WHEN acct IS NULL THEN 'missing_iban' WHEN t IS NULL THEN 'parse_error:ValueError' WHEN amount IS NULL THEN 'parse_error:ValueError' END AS reason FROM d)"""

_EXT = "sha256(account_id || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('us', ts)::BIGINT % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00|' || printf('%.2f', amount) || '|USD|' || lower(counterparty) || '|' || direction)"

_FEATURES = """SELECT id AS transaction_id, account_id, round((amount - {mean}) / greatest(coalesce({sd}, 0), 1e-9), 4) + 0.0::DOUBLE AS amount_zscore,
  (count(*) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1)::DOUBLE AS velocity_1h,
  (count(*) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - 1)::DOUBLE AS velocity_24h,
  {cp}::DOUBLE AS counterparty_diversity, {co}::DOUBLE AS country_diversity,
  round(sin(2 * pi() * (hour(ts) + minute(ts) / 60) / 24), 4) + 0.0::DOUBLE AS time_of_day_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60) / 24), 4) + 0.0::DOUBLE AS time_of_day_cos
FROM l1"""
_ALL, _SOFAR = "OVER (PARTITION BY account_id)", "OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _features(over: str) -> str:
    return f"WITH {_L1} " + _FEATURES.format(
        mean=f"avg(amount) {over}", sd=f"stddev_samp(amount) {over}", cp=f"count(DISTINCT counterparty) {over}", co=f"count(DISTINCT country) {over}"
    )


_PERIOD = "f AS (SELECT * FROM a WHERE created_at >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAYS)"
_ITEMS = """i AS (
  SELECT account_id AS case_id, id AS alert_id, NULL::BIGINT AS transaction_id FROM a
  UNION ALL SELECT account_id, NULL, transaction_id FROM a WHERE id % 10 = 0)"""
_FIRSTS = "g AS (SELECT case_id, min(a.created_at) AS first_alert_at, count(*) AS alert_count FROM i JOIN a ON i.alert_id = a.id GROUP BY case_id)"
_LOGS = """l AS (
  SELECT event_id AS id, event_type AS action, sha256(event_id::VARCHAR) AS row_hash,
    CASE WHEN event_id % 97 = 96 THEN 'broken' WHEN event_id > 0 THEN sha256((event_id - 1)::VARCHAR) END AS prev_hash FROM events)"""


def _pct(col: str, p: float, src: str) -> str:
    return f"(SELECT {col} FROM {src} ORDER BY {col} LIMIT 1 OFFSET (SELECT least(floor({p}::DOUBLE * count(*))::BIGINT, count(*) - 1) FROM {src}))"


_HOP = """hops AS (
  SELECT (SELECT min(src) FROM p) AS node, 0 AS hop
  UNION SELECT p.dst, hop + 1 FROM hops JOIN p ON hops.node = p.src WHERE hop < 2)"""
_PATHS = """walks AS (
  SELECT [(SELECT min(src) FROM p)] AS path
  UNION ALL SELECT list_append(path, p.dst) FROM walks JOIN p ON path[-1] = p.src
  WHERE len(path) <= {hops} AND NOT list_contains(path, p.dst) AND path[-1] <> (SELECT z FROM z))"""
#: One path for each node, the least of the shortest, up to six hops: more than any two accounts of the small tables need.
_LEVELS = "f0 AS (SELECT min(src) AS node, [min(src)] AS path FROM p), " + ", ".join(
    f"f{i} AS (SELECT * FROM f{i - 1} UNION ALL SELECT dst, min(list_append(path, dst)) FROM f{i - 1} JOIN p ON node = src"
    f" WHERE len(path) = {i} AND dst NOT IN (SELECT node FROM f{i - 1}) GROUP BY dst)"
    for i in range(1, 7)
)

ORACLES: dict[str, str] = {
    "high_value_alerts": _rule("HighValueTransaction"), "keyword_alerts": _rule("SanctionsKeywordMatch"),
    "high_risk_country_alerts": _rule("HighRiskCountry"), "rapid_velocity": _rule("RapidVelocity"), "geo_mismatch": _rule("GeoMismatch"),
    "structuring": _rule("StructuringSmurfing"),
    "rule_pack_alerts": f"WITH {_L1}, {_HITS} SELECT id AS transaction_id, account_id, rule_id, severity, d AS score FROM h",
    "risk_scores": f"WITH {_L1}, {_HITS} SELECT id, account_id, n::BIGINT AS n_hits, risk_score, band FROM b",
    "risk_band_counts": f"WITH {_L1}, {_HITS} SELECT band, count(*)::BIGINT AS n FROM b GROUP BY band",
    "stateless_scores": f"""WITH {_L1}, t AS (SELECT id, least(base_risk + CASE WHEN amount >= 10000 THEN 25 ELSE 0 END + CASE WHEN contains(lower(counterparty), 'cp 13')
      OR contains(lower(counterparty), 'cp 7') THEN 30 ELSE 0 END + CASE WHEN country IN ('N1', 'N7') THEN 25 ELSE 0 END, 100)::DOUBLE AS risk_score FROM l1)
      SELECT id, risk_score, CASE WHEN risk_score < 33 THEN 'low' WHEN risk_score < 66 THEN 'medium' ELSE 'high' END AS band FROM t""",
    "score_v2_profiles": f"""WITH {_L1}, {_HITS}, z AS (SELECT w.id, h.severity, h.d, {_DECAY.format(end="2024-01-31", ts="w.ts")} AS f FROM w LEFT JOIN h ON w.id = h.id)
      SELECT id, {_v2("conservative", {"critical": 2.5, "high": 2.0, "medium": 1.5, "low": 1.0}, 15)},
      {_v2("balanced", {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5}, 10)}, {_v2("aggressive", {"critical": 1.5, "high": 1.0, "medium": 0.7, "low": 0.3}, 5)}
      FROM z GROUP BY id""",
    "temporal_decay": f"""WITH {_L4} SELECT severity, round(sum(score * {_DECAY.format(end="2001-08-02", ts="created_at")}
      * CASE severity WHEN 'critical' THEN 2.0::DOUBLE WHEN 'high' THEN 1.5::DOUBLE WHEN 'medium' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 4) AS decayed, count(*)::BIGINT AS n FROM a GROUP BY severity""",
    "customer_risk_profile": f"""WITH {_L4}, t AS (SELECT account_id, count(*)::BIGINT AS n, count(*) FILTER (severity = 'critical')::BIGINT AS critical,
      count(*) FILTER (severity = 'high')::BIGINT AS high, count(*) FILTER (severity = 'medium')::BIGINT AS medium, count(*) FILTER (severity = 'low')::BIGINT AS low,
      epoch(TIMESTAMP '2001-08-02' - max(created_at)) / 86400 AS days FROM a GROUP BY account_id)
      SELECT account_id, n, critical, high, medium, low, round(days, 2)::DOUBLE AS days_since_last, round((4 * critical + 3 * high + 2 * medium + low) * least(n / 5, 3.0)
      * CASE WHEN days <= 1 THEN 2.0 WHEN days <= 7 THEN 1.5 WHEN days <= 30 THEN 1.0 ELSE 0.5 END, 2)::DOUBLE AS risk FROM t""",
    "ingest_normalize": f"""WITH {_DIRTY} SELECT i::VARCHAR AS source_id, acct AS iban_or_acct, strftime(date_trunc('second', t), '%Y-%m-%d %H:%M:%S') AS ts, amount::DOUBLE AS amount,
      currency, counterparty, base_risk, 'XXX' AS country, 'Unknown' AS customer_name FROM k WHERE reason IS NULL""",
    "ingest_rejects": f"WITH {_DIRTY} SELECT reason, count(*)::BIGINT AS n FROM k WHERE reason IS NOT NULL GROUP BY reason",
    "external_id": f"WITH {_L1} SELECT id, {_EXT} AS external_id FROM l1",
    "ingest_dedup": f"""WITH {_L1} SELECT min(id) AS id, account_id FROM l1 GROUP BY account_id, ts, amount, counterparty, direction""",
    "insert_if_absent": f"WITH {_L1} SELECT id, account_id, amount FROM l1 WHERE id % 4 = 1",
    "build_edges": f"""WITH {_L2}, {_EDGES.format(src='l2')} SELECT src_type, src_id, dst_type, dst_key, strftime(first_seen_at, '%Y-%m-%d') AS first_seen_at,
      strftime(last_seen_at, '%Y-%m-%d') AS last_seen_at, txn_count::BIGINT AS txn_count FROM e""",
    "edge_upsert": f"""WITH {_L2}, {_RECENT}, {_EDGES.format(src='r')},
      {_EDGES.format(src='l2').replace('e AS', 'o AS', 1)} SELECT o.src_type, o.src_id, o.dst_type, o.dst_key, strftime(o.first_seen_at, '%Y-%m-%d') AS first_seen_at,
      coalesce(e.txn_count, o.txn_count)::BIGINT AS txn_count FROM o LEFT JOIN e USING (src_type, src_id, dst_type, dst_key)""",
    "ring_signal": f"""WITH {_SUPPLY}, j AS (SELECT a.account_id, b.account_id AS other, a.dst_key FROM x a JOIN x b ON a.dst_key = b.dst_key AND a.account_id <> b.account_id)
      SELECT account_id, count(DISTINCT other)::BIGINT AS linked, count(DISTINCT dst_key)::BIGINT AS overlap_count,
      (SELECT count(*) FROM x WHERE x.account_id = j.account_id)::BIGINT AS degree, array_to_string(list_sort(list(DISTINCT dst_key)), ',') AS shared FROM j GROUP BY account_id""",
    "ring_alerts": f"""WITH {_SUPPLY}, j AS (SELECT a.account_id, b.account_id AS other, a.dst_key FROM x a JOIN x b ON a.dst_key = b.dst_key AND a.account_id <> b.account_id),
      k AS (SELECT account_id FROM j GROUP BY account_id HAVING count(DISTINCT other) >= 2 AND count(DISTINCT dst_key) >= 2)
      SELECT min(id) AS transaction_id, 'NetworkRingIndicator' AS rule_id, 40.0::DOUBLE AS score_delta FROM r JOIN k USING (account_id) GROUP BY account_id""",
    "account_projection": f"""WITH {_WHOLE} SELECT a.account_id AS src, b.account_id AS dst, sum(a.txn_count + b.txn_count)::BIGINT AS txn_count,
      array_to_string(list_sort(list(DISTINCT a.dst_key)), ',') AS shared, strftime(max(greatest(a.last_seen_at, b.last_seen_at)), '%Y-%m-%d') AS last_seen_at
      FROM x a JOIN x b ON a.dst_key = b.dst_key AND a.account_id <> b.account_id GROUP BY a.account_id, b.account_id""",
    "graph_nodes": f"""WITH {_L4} SELECT c_custkey AS account_id, c_name AS customer_name, coalesce((SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey), 0) AS total_amount,
      (SELECT count(*) FROM a WHERE a.account_id = c_custkey)::BIGINT AS alert_count FROM customer""",
    "common_owners": f"""WITH {_L1}, t AS (SELECT DISTINCT account_id, customer_id FROM l1)
      SELECT customer_id, 'C' || customer_id AS customer_name, string_agg(account_id::VARCHAR, ',' ORDER BY account_id) AS account_ids FROM t GROUP BY customer_id HAVING count(*) >= 2""",
    "account_neighbourhood": f"""WITH {_L2}, {_EDGES.format(src='l2')}, s AS (SELECT min(src_id) AS i FROM e WHERE src_type = 'account'),
      k AS (SELECT src_id, dst_key FROM e WHERE src_type = 'account' AND dst_type = 'counterparty' AND last_seen_at >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAYS),
      j AS (SELECT a.dst_key, b.src_id AS other FROM k a JOIN k b ON a.dst_key = b.dst_key AND a.src_id <> b.src_id WHERE a.src_id = (SELECT i FROM s)),
      g AS (SELECT count(DISTINCT dst_key)::BIGINT AS overlap_count, count(DISTINCT other)::BIGINT AS linked FROM j)
      SELECT row_number() OVER (ORDER BY dst_type, dst_key)::BIGINT AS place, dst_type, dst_key, txn_count::BIGINT AS txn_count, overlap_count, linked,
      (SELECT count(*) FROM k WHERE src_id = (SELECT i FROM s))::BIGINT AS degree FROM e, g WHERE src_type = 'account' AND src_id = (SELECT i FROM s)""",
    "ownership_chain": f"""WITH {_WHOLE}, o AS (SELECT a.account_id, b.account_id AS linked_account, count(DISTINCT a.dst_key)::BIGINT AS shared_count
      FROM x a JOIN x b ON a.dst_key = b.dst_key AND a.account_id <> b.account_id GROUP BY ALL HAVING count(DISTINCT a.dst_key) >= 2), s AS (SELECT min(account_id) AS i FROM o),
      u AS (SELECT i AS linked_account, 'direct_owner' AS relation, 0::BIGINT AS shared_count FROM s
      UNION ALL SELECT linked_account, 'shared_counterparties', shared_count FROM o WHERE account_id = (SELECT i FROM s))
      SELECT linked_account, c_custkey AS customer_id, c_name AS customer_name, relation, shared_count FROM u JOIN customer ON c_custkey = linked_account""",
    "ownership_links": f"""WITH {_WHOLE} SELECT a.account_id, b.account_id AS linked_account, count(DISTINCT a.dst_key)::BIGINT AS shared_count
      FROM x a JOIN x b ON a.dst_key = b.dst_key AND a.account_id <> b.account_id GROUP BY ALL HAVING count(DISTINCT a.dst_key) >= 2""",
    "khop_subgraph": f"WITH RECURSIVE {_PROJECTED}, {_HOP} SELECT node, min(hop)::BIGINT AS hop FROM hops GROUP BY node",
    "shortest_path": f"""WITH {_PROJECTED}, {_LEVELS} SELECT array_to_string(path, ',') AS path FROM f6 WHERE node = (SELECT max(src) FROM p)""",
    "simple_paths": f"""WITH RECURSIVE {_PROJECTED}, {_HOP}, z AS (SELECT max(node) AS z FROM hops), {_PATHS.format(hops=3)}
      SELECT array_to_string(path, ',') AS path FROM walks WHERE path[-1] = (SELECT z FROM z)""",
    "money_flow_edges": f"""WITH {_L2}, t AS (SELECT account_id, lower(trim(counterparty)) AS counterparty, round(sum(amount), 2) AS total_amount, count(*)::BIGINT AS txn_count
      FROM l2 WHERE direction = 'out' AND ts >= TIMESTAMP '2001-12-01' - INTERVAL 90 DAYS GROUP BY ALL)
      SELECT t.*, coalesce(s_suppkey + 1000000, -1)::BIGINT AS to_account FROM t LEFT JOIN supplier ON lower(s_name) = counterparty""",
    "connected_components": f"""WITH RECURSIVE {_PROJECTED}, t AS (SELECT DISTINCT src AS node, src AS r FROM p UNION SELECT t.node, p.dst FROM t JOIN p ON t.r = p.src)
      SELECT node, min(r) AS component FROM t GROUP BY node""",
    "suspicious_communities": f"""WITH {_L4}, t AS (SELECT account_id, count(*) FILTER (severity = 'critical') AS n, sum(amount) AS v FROM a GROUP BY account_id),
      g AS (SELECT c_nationkey::BIGINT AS community, count(*)::BIGINT AS size, sum(n)::BIGINT AS alerts, count(*) FILTER (n > 0) / count(*) AS ratio, round(sum(v), 2) AS volume
      FROM customer JOIN t ON c_custkey = account_id GROUP BY c_nationkey)
      SELECT community, size, alerts, round(ratio, 6) AS alert_ratio, volume, round(50 * ratio + 2 * least(alerts, 20) + least(size, 10), 2)::DOUBLE AS risk_score FROM g WHERE ratio >= 0.3""",
    "fuzzy_levenshtein": f"""WITH {_LIST} SELECT name, entry, round(1 - levenshtein(name, entry)::DOUBLE / greatest(length(name), length(entry)), 4) AS score FROM n, q
      WHERE round(1 - levenshtein(name, entry)::DOUBLE / greatest(length(name), length(entry)), 4) >= 0.35""",
    "fuzzy_jaro_winkler": f"WITH {_LIST} SELECT name, entry, round(jaro_winkler_similarity(name, entry), 4) AS score FROM n, q WHERE round(jaro_winkler_similarity(name, entry), 4) >= 0.72",
    "pep_screening": f"""WITH {_LIST}, u(entry_id, entry) AS (VALUES (0::BIGINT, 'cold widgit'), (0, 'widgit cold'), (2, 'large bolts'), (2, 'bolts large')),
      m AS (SELECT name, entry_id, max(1 - levenshtein(name, entry)::DOUBLE / greatest(length(name), length(entry))) AS s FROM n, u GROUP BY ALL)
      SELECT name, entry_id, round(s, 4) AS score FROM m WHERE s >= 0.35""",
    "feature_matrix": _features(_ALL), "online_features": _features(_SOFAR),
    "tune_thresholds": f"""SELECT greatest(1000, round_even({_pct("o_totalprice", 0.99, "orders")} / 1000, 0) * 1000)::DOUBLE AS high_value,
      greatest(1000, round_even({_pct("o_totalprice", 0.95, "orders")} / 500, 0) * 500)::DOUBLE AS structuring""",
    "tune_velocity": f"""WITH {_L1}, t AS (SELECT account_id, max(n) AS peak FROM (SELECT account_id, floor(epoch(ts) / 900) AS b, count(*) AS n FROM l1 GROUP BY ALL) GROUP BY account_id)
      SELECT greatest(3, {_pct("peak", 0.9, "t")} + 1)::BIGINT AS min_transactions""",
    "kpi_summary": f"""WITH {_L4}, {_PERIOD} SELECT count(*)::BIGINT AS total_alerts, count(disposition)::BIGINT AS dispositioned,
      round(count(*) FILTER (disposition = 'sar') / count(disposition), 4) AS sar_rate, round(count(*) FILTER (disposition = 'false_positive') / count(disposition), 4) AS false_positive_rate,
      round(avg(epoch(updated_at - created_at) / 86400), 4) AS avg_days_to_disposition FROM f""",
    "kpi_by_severity": f"WITH {_L4}, {_PERIOD} SELECT severity, count(*)::BIGINT AS n FROM f GROUP BY severity",
    "kpi_by_disposition": f"WITH {_L4}, {_PERIOD} SELECT coalesce(disposition, 'pending') AS disposition, count(*)::BIGINT AS n FROM f GROUP BY ALL",
    "kpi_trend": f"""WITH {_L4}, {_PERIOD}, t AS (SELECT created_at::DATE AS d, count(*) AS n FROM f GROUP BY ALL),
      s AS (SELECT unnest(generate_series(DATE '2001-08-02' - 365, DATE '2001-08-02' - 1, INTERVAL 1 DAY))::DATE AS d)
      SELECT strftime(coalesce(s.d, t.d), '%Y-%m-%d') AS day, coalesce(n, 0)::BIGINT AS n FROM s FULL JOIN t ON s.d = t.d""",
    "kpi_backlog": f"""WITH {_L4}, t AS (SELECT floor(epoch(TIMESTAMP '2001-08-02' - created_at) / 86400) AS d FROM a WHERE status = 'open')
      SELECT CASE WHEN d < 7 THEN '0-7' WHEN d < 14 THEN '7-14' WHEN d < 30 THEN '14-30' ELSE '30+' END AS bucket, count(*)::BIGINT AS n FROM t GROUP BY ALL""",
    "kpi_top_rules": f"WITH {_L4}, {_PERIOD} SELECT rule_id, count(*)::BIGINT AS n FROM f GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 5",
    "overdue_cases": f"""WITH {_L4}, {_CASES}, {_ITEMS}, {_FIRSTS} SELECT c.id AS case_id, status, priority, strftime(first_alert_at + INTERVAL 30 DAYS, '%Y-%m-%d') AS deadline,
      alert_count::BIGINT AS alert_count, floor(epoch(TIMESTAMP '2001-08-02' - (first_alert_at + INTERVAL 30 DAYS)) / 86400)::BIGINT AS days_overdue
      FROM c JOIN g ON c.id = g.case_id WHERE status IN ('NEW', 'INVESTIGATING') AND first_alert_at + INTERVAL 30 DAYS < TIMESTAMP '2001-08-02'""",
    "timeline_metrics": f"""WITH {_L4}, {_CASES}, {_ITEMS}, {_FIRSTS} SELECT count(*) FILTER (status <> 'CLOSED')::BIGINT AS open_cases, count(*) FILTER (status = 'CLOSED')::BIGINT AS closed_cases,
      count(*) FILTER (status <> 'CLOSED' AND first_alert_at + INTERVAL 30 DAYS < TIMESTAMP '2001-08-02')::BIGINT AS overdue_cases,
      round(avg(epoch(updated_at - first_alert_at) / 86400) FILTER (status = 'CLOSED'), 4) AS avg_days_to_close,
      round(count(*) FILTER (status = 'CLOSED' AND updated_at <= first_alert_at + INTERVAL 30 DAYS) / count(*) FILTER (status = 'CLOSED'), 4) AS on_time_rate FROM c LEFT JOIN g ON c.id = g.case_id""",
    "sar_rollup": f"""WITH {_L4} SELECT account_id AS case_id, round(sum(amount), 2) AS total_amount, strftime(min(created_at), '%Y-%m-%d') AS period_start, count(*)::BIGINT AS txn_count,
      array_to_string(list_sort(list(DISTINCT 'ch' || (id % 4))), ',') AS channels, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rule_ids, count(*)::BIGINT AS alert_count FROM a GROUP BY account_id""",
    "sar_flat": f"""WITH {_L4} SELECT id, rule_id, severity, status, disposition, account_id AS txn_account_id, amount AS txn_amount,
      round(epoch(updated_at - created_at) / 3600, 2)::DOUBLE AS hours_to_disposition FROM a""",
    "chain_verify": f"""WITH {_LOGS}, t AS (SELECT *, lag(row_hash) OVER (ORDER BY id) AS expected FROM l) SELECT id, prev_hash, expected FROM t WHERE prev_hash IS DISTINCT FROM expected""",
    "audit_summary": f"""WITH {_L4}, {_CASES}, {_LOGS} SELECT 'severity:' || severity AS metric, count(*)::BIGINT AS n FROM a GROUP BY ALL
      UNION ALL SELECT 'disposition:' || coalesce(disposition, 'pending'), count(*) FROM a GROUP BY ALL UNION ALL SELECT 'status:' || status, count(*) FROM c GROUP BY ALL
      UNION ALL SELECT 'action:' || action, count(*) FROM l GROUP BY ALL""",
    "alerts_page": f"WITH {_L4} SELECT id, severity, account_id FROM a WHERE severity = 'high' AND id > 1000 ORDER BY id LIMIT 51",
    "case_view": f"WITH {_L4}, {_CASES} SELECT c.id, c.status, count(*)::BIGINT AS n_items, string_agg(a.id::VARCHAR, ',' ORDER BY a.id) AS alert_ids FROM c JOIN a ON a.account_id = c.id GROUP BY c.id, c.status",
    "case_moves": """WITH s(x, i) AS (VALUES ('NEW', 0), ('INVESTIGATING', 1), ('ESCALATED', 2), ('CLOSED', 3)) SELECT a.x AS old, b.x AS new, b.i > a.i AS allowed FROM s a, s b""",
    "run_bundle": f"""WITH {_L4}, {_CASES}, {_LOGS}, {_ITEMS} SELECT 'alerts' AS part, count(*)::BIGINT AS n FROM a WHERE id % 5 = 2 UNION ALL SELECT 'audit_logs', count(*) FROM l WHERE id % 5 = 2
      UNION ALL SELECT 'cases', count(*) FROM c WHERE id % 5 = 2 UNION ALL SELECT 'transactions', count(*) FROM a WHERE id % 5 = 2 UNION ALL SELECT 'case_items', count(*) FROM i WHERE case_id % 5 = 2""",
    "dashboard": f"WITH {_L4} SELECT severity, status, count(*)::BIGINT AS n, round(avg(score), 4) AS mean_score FROM a GROUP BY ALL",
    "money_trace": f"""WITH {_L1}, t AS (SELECT account_id, lower(counterparty) AS counterparty, round(sum(amount), 2) AS total_amount, count(*)::BIGINT AS txn_count
      FROM l1 WHERE direction = 'out' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAYS GROUP BY ALL),
      f AS (SELECT t.*, coalesce(u.id, -1)::BIGINT AS child FROM t LEFT JOIN (SELECT DISTINCT account_id AS id FROM l1) u ON counterparty = 'cp ' || (2 * u.id)),
      s0 AS (SELECT min(account_id) AS v FROM l1),
      d1 AS (SELECT f.*, 1::BIGINT AS depth FROM f WHERE account_id IN (SELECT v FROM s0) AND child NOT IN (SELECT v FROM s0)), s1 AS (FROM s0 UNION SELECT child FROM d1 WHERE child >= 0),
      d2 AS (SELECT f.*, 2::BIGINT AS depth FROM f WHERE account_id IN (SELECT child FROM d1 WHERE child >= 0) AND child NOT IN (SELECT v FROM s1)
        QUALIFY child < 0 OR account_id = min(account_id) OVER (PARTITION BY child)), s2 AS (FROM s1 UNION SELECT child FROM d2 WHERE child >= 0),
      d3 AS (SELECT f.*, 3::BIGINT AS depth FROM f WHERE account_id IN (SELECT child FROM d2 WHERE child >= 0) AND child NOT IN (SELECT v FROM s2)
        QUALIFY child < 0 OR account_id = min(account_id) OVER (PARTITION BY child))
      SELECT account_id AS parent, child, counterparty, total_amount, txn_count, depth FROM (FROM d1 UNION ALL FROM d2 UNION ALL FROM d3)""",
    "screening_alerts": f"""WITH {_L1}, q(e, name, alias, sev) AS (VALUES (0, 'CP 13', 'cp 13', 'high'), (0, 'CP 13', 'cp 31', 'high'), (1, 'Cp 70', 'cp 70', 'medium')),
      m AS (SELECT c, e, name, sev, round(max(1 - levenshtein(lower(c), alias)::DOUBLE / greatest(length(c), length(alias))), 4) AS s
        FROM (SELECT DISTINCT counterparty AS c FROM l1), q GROUP BY ALL),
      h AS (SELECT c, name, 'high' AS severity, 30.0::DOUBLE AS score, s FROM m WHERE s >= 0.79 UNION ALL SELECT c, name, sev, 24.0::DOUBLE, s FROM m WHERE s >= 0.99)
      SELECT id AS transaction_id, 'SanctionsScreening' AS rule_id, severity, score, name AS matched_name, s AS confidence FROM l1 JOIN h ON counterparty = c""",
    "keyword_screening": f"""WITH {_L1}, t AS (SELECT id, CASE WHEN contains(lower(counterparty), 'p 13') THEN 'p 13' WHEN contains(lower(counterparty), 'cp 7') THEN 'cp 7' END AS keyword FROM l1)
      SELECT id AS transaction_id, 'high' AS severity, 30.0::DOUBLE AS score, keyword FROM t WHERE keyword IS NOT NULL""",
    "transactions_in_context": """SELECT o_orderkey AS id, o_custkey AS account_id, n_nationkey::BIGINT AS customer_id, o_totalprice AS amount, n_regionkey::DOUBLE AS base_risk
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "alerts_between": f"WITH {_L4} SELECT id, severity, account_id FROM a WHERE created_at BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'",
    "ingest_counts": f"""WITH {_DIRTY} SELECT count(*)::BIGINT AS rows_read, count(reason)::BIGINT AS rows_rejected, (count(*) - count(reason))::BIGINT AS rows_inserted FROM k""",
    "redacted_lines": f"""WITH {_L1} SELECT id, 'alert ' || id || ' (Counterparty=[REDACTED], merchant=[REDACTED]) amount=' || amount::VARCHAR AS line FROM l1""",
    "planted_patterns": """SELECT CASE WHEN i < 5 THEN 'velocity' WHEN i < 8 THEN 'structuring' WHEN i < 12 THEN 'countries' WHEN i < 14 THEN 'ring' WHEN i < 15 THEN 'listed' END AS pattern,
      count(*)::BIGINT AS n, count(*)::BIGINT AS n_ids FROM (SELECT (row_number() OVER () - 1) % 1000 AS i FROM orders) GROUP BY ALL""",
    "stream_dedup": "SELECT event_id, event_type FROM events",
    "stream_sliding_stats": f"""WITH {_L1}, t AS (SELECT id, account_id, amount, counterparty, count(*) OVER w AS n, sum(amount) OVER w AS total, count(DISTINCT counterparty) OVER w AS cp FROM l1
      WINDOW w AS (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW))
      SELECT account_id, id AS event_id, n::BIGINT AS n, round(total, 2) AS total, cp::BIGINT AS counterparties FROM t""",
}
