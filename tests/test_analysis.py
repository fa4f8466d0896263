import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions import text
from ledgerwatch.operators import features, graph, lifecycle, paging, reporting, screening, tuning
from ledgerwatch.schemas import NAME_LIST
from ledgerwatch.streaming import pipeline

T0 = datetime(2024, 1, 1)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_names():
    assert text.plain_name("  Mohammed  Ál-Ahmad, Limited ") == "muhammad al ahmad ltd" and text.plain_name(None) == ""
    assert text.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and text.jaro_winkler("", "a") == 0.0


def test_screening(spark):
    e = spark.createDataFrame([(1, "Juan Garcia", ["J Garcia"], "individual", "custom", "ES", None, "high", {}), (2, "Other Body", [], "organization", "custom", "IR", None, "low", {})], NAME_LIST)
    names = spark.createDataFrame([("juan garcía",), ("John Smith",), (None,), ("",), ("juan garcía",)], "name string")
    out = screening.search(names, e, 0.85).collect()
    assert [(r["name"], r["entry_id"], r["score"], r["algorithm"]) for r in out] == [("juan garcía", 1, 1.0, "exact")]
    assert screening.search(names, e, 0.85, country="ir").count() == 0


def test_length_classes_lose_nothing(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(80)]
    names = spark.createDataFrame([(w,) for w in words], "name string")
    e = spark.createDataFrame([(i, w, [], "x", "x", None, None, "low", {}) for i, w in enumerate(words[:30])], NAME_LIST)
    for t in (0.5, 0.8):
        fast = {(r["name"], r["entry_id"]) for r in screening.matches(names, e, t, ("levenshtein",)).collect()}
        slow = {(r["name"], r["entry_id"]) for r in screening.matches(names, e, t, ("levenshtein", "phonetic")).where("algorithm = 'levenshtein'").collect()}
        assert slow <= fast


def test_edges_are_dealt_by_the_ledger(spark):
    rows = [(1, 1, "A ", "m", 0), (1, 1, "a", None, 5), (1, 2, "a", "M", 9), (2, 2, "b", " ", 1), (2, 1, "A", "m", 2), (3, None, "", "m", 3), (None, None, "c", None, 4)]
    t = spark.createDataFrame([(a, c, p, m, T0 + timedelta(days=d)) for a, c, p, m, d in rows], "account_id long, customer_id long, counterparty string, merchant string, ts timestamp")
    want = {}
    for a, c, p, m, d in rows:
        for e, k in ((("account", a, "counterparty"), p), (("account", a, "merchant"), m), (("customer", c, "counterparty"), p)):
            if k and k.strip():
                want.setdefault((*e, k.strip().lower()), []).append(T0 + timedelta(days=d))
    want = {k: (min(v), max(v), len(v)) for k, v in want.items()}
    many = 40 * graph.ENDS_PER_TASK
    got = graph.build_edges(t, many)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()} == {tuple(r)[:4]: tuple(r)[4:] for r in graph.build_edges(t).collect()} == want
    for kind in graph.EDGE_KINDS:
        assert {tuple(r)[:4] for r in graph.build_edges(t, kinds=[kind]).collect()} == {k for k in want if (k[0], k[2]) == kind}
    # The tasks grow with the ledger.
    assert got.rdd.getNumPartitions() >= 3 * 40


def test_merged_edges_meet_where_they_were_made(spark):
    t = spark.createDataFrame([(i % 4, i % 4, f"c{i % 3}", "m", T0 + timedelta(days=i)) for i in range(30)], "account_id long, customer_id long, counterparty string, merchant string, ts timestamp")
    many = 40 * graph.ENDS_PER_TASK
    old, new = graph.build_edges(t, many), graph.build_edges(t.where(F.col("ts") >= T0 + timedelta(days=20)), many)
    both = graph.upsert_edges(old, new)
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert both.rdd.getNumPartitions() >= 3 * 40
    was, now = ({tuple(r)[:4]: r["txn_count"] for r in e.collect()} for e in (old, new))
    assert {tuple(r)[:4]: r["txn_count"] for r in both.collect()} == was | now


def test_neighbourhood_sums_no_edges_of_all_accounts(spark, monkeypatch):
    from ledgerwatch.plans import queries

    # Account 1 makes no edge; 2 has old and new ones, 4 shares a counterparty with it too long ago.
    rows = [(1, " ", "", -1), (2, "a", "m", -400), (2, "a", "m", -1), (2, "b", None, -1), (3, "A", "m", -2), (4, "b", "n", -60), (5, "b", "n", -60), (5, "B", "o", -3)]
    t = spark.createDataFrame([(a, a, p, m, queries.RING_AT + timedelta(days=d)) for a, p, m, d in rows], "account_id long, customer_id long, counterparty string, merchant string, ts timestamp")
    made, build = [], graph.build_edges
    monkeypatch.setattr(queries, "ledger_lineitem", lambda *_: t)
    monkeypatch.setattr(graph, "build_edges", lambda txns, *a, **k: made.append(txns.count()) or build(txns, *a, **k))
    monkeypatch.setattr(queries, "table", lambda *_: t)
    got = queries.account_neighbourhood(spark, "").collect()
    assert [tuple(r) for r in got] == [(1, "counterparty", "a", 2, 2, 2, 2), (2, "counterparty", "b", 1, 2, 2, 2), (3, "merchant", "m", 2, 2, 2, 2)]
    assert made == [6]


def test_pairs_of_accounts_are_made_once(spark, monkeypatch):
    from ledgerwatch.plans import queries

    seen = spark.sparkContext.accumulator(0)
    look = F.udf(lambda k: seen.add(1) or k, "string").asNondeterministic()
    t = spark.createDataFrame([(i, i, f"c{j}", "m", T0) for i, j in [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 3), (4, 4), (1, 4)]], "account_id long, customer_id long, counterparty string, merchant string, ts timestamp")
    monkeypatch.setattr(queries, "ledger_deliveries", lambda *_: t.withColumn("counterparty", look("counterparty")))
    monkeypatch.setattr(queries, "table", lambda *_: t)
    assert sorted(r["path"] for r in queries.simple_paths(spark, "").collect()) == ["1,2,3,4", "1,4"]
    assert seen.value <= 2 * t.count()
    sizes = {tuple(sorted(r)) for r in queries.louvain_communities(spark, "").collect()}
    assert len(sizes) == 4 and seen.value <= 4 * t.count()


def test_paths(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (7, 8)])
    assert graph.shortest_path(e, 1, 5).first()["path"] == [1, 2, 3, 5]
    assert graph.shortest_path(e, 1, 8).count() == 0
    assert sorted(r["path"] for r in graph.simple_paths(e, 1, 3, 3).collect()) == [[1, 2, 3], [1, 4, 3]]
    assert {r["node"]: r["hop"] for r in graph.k_hop(e, 1, 2).collect()} == {1: 0, 2: 1, 4: 1, 3: 2}
    assert {r["node"]: r["component"] for r in graph.connected(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7}


def test_shortest_path_has_no_cutoff(spark):
    chain = edges(spark, [(i, i + 1) for i in range(12)])
    assert graph.shortest_path(chain, 0, 12).first()["path"] == list(range(13))
    assert graph.shortest_path(chain, 0, 12, max_hops=11).count() == 0 and graph.shortest_path(chain, 0, 99).count() == 0


def test_communities(spark):
    clique = lambda ns: [(a, b) for a in ns for b in ns if a < b]
    e = edges(spark, clique(range(5)) + clique(range(10, 15)) + [(4, 10)])
    for f in (graph.louvain, graph.label_propagation):
        out = {r["node"]: r["community"] for r in f(e).collect()}
        assert len({out[n] for n in range(4)}) == 1 and len({out[n] for n in range(11, 15)}) == 1 and out[0] != out[14]


def test_communities_are_stable(spark):
    sides = [(a, b) for a in (20, 21, 22) for b in (30, 31, 32)]
    pairs = [(1, 2), (3, 4), *sides, *[(i, i + 1) for i in range(40, 52)]]
    out = {r["node"]: r["community"] for r in graph.label_propagation(edges(spark, pairs)).collect()}
    assert out[1] == out[2] and out[3] == out[4] and out[1] != out[3] and len({out[n] for p in sides for n in p}) == 1
    for n in out:
        near = [out[b if a == n else a] for a, b in pairs if n in (a, b)]
        assert near.count(out[n]) == max(near.count(x) for x in near)


def test_large_components_by_modularity(spark):
    clique = lambda ns: [(a, b) for a in ns for b in ns if a < b]
    e = edges(spark, [(1, 2), *clique(range(10, 14)), *clique(range(20, 24)), *clique(range(30, 34)), (13, 20), (23, 30), (33, 10)])
    want = {1: 1, 2: 1} | {n: n // 10 * 10 for k in (10, 20, 30) for n in range(k, k + 4)}
    for most in (1, 200_000):
        assert {r["node"]: r["community"] for r in graph.louvain(e, max_component=most).collect()} == want


def test_flow(spark):
    t = spark.createDataFrame(
        [(1, "acc-2", 10.0, "out", T0), (1, "acc-2", 5.0, "out", T0), (2, "ACC-3", 7.0, "out", T0), (3, "acc-1", 1.0, "out", T0), (1, "nowhere", 2.0, "out", T0), (1, "acc-3", 9.0, "in", T0)],
        "account_id long, counterparty string, amount double, direction string, ts timestamp",
    )
    a = spark.createDataFrame([(i, f"Acc-{i}") for i in (1, 2, 3)], "id long, iban_or_acct string")
    flows = graph.flow_edges(t, a, F.lit("2024-01-05").cast("timestamp"))
    out = [(r["parent"], r["child"], r["total_amount"], r["depth"]) for r in graph.trace_flow(flows, 1).collect()]
    assert sorted(out) == [(1, -1, 2.0, 1), (1, 2, 15.0, 1), (2, 3, 7.0, 2)]


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 7)), np.full((5, 7), 9.0)])
    f = features.IsolationForest().fit(x)
    s = f.anomaly(x)
    assert s[500:].min() > np.quantile(s[:500], 0.99)
    assert np.allclose(features.IsolationForest.from_json(f.to_json()).anomaly(x), s)


def test_offset_comes_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(features, "TRAIN_ROWS", 40)
    x = np.random.default_rng(3).normal(size=(702, len(features.NAMES)))
    rows = [(i, i % 9, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "transaction_id long, account_id long, " + ", ".join(f"{c} double" for c in features.NAMES))
    forest, _ = features.train_forest(df)
    assert forest.offset == pytest.approx(np.quantile(forest.score(x), 0.05), abs=1e-12)
    out = features.anomaly_scores(df, forest).orderBy("transaction_id").toPandas()["anomaly_score"]
    assert np.allclose(out, forest.anomaly(x)) and (out > 0.5).sum() == 36


def test_percentile_is_the_floor_index(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    for p, want in ((0.99, 100.0), (0.5, 51.0), (1.0, 100.0), (0.0, 1.0)):
        assert tuning.percentile(df, "v", p).first()["value"] == want
    assert tuning.percentile(df.where("v < 0"), "v", 0.5).count() == 0
    amounts = spark.createDataFrame([(a,) for a in (500.0, 600.0, 700.0, 100000.0)], "amount double")
    assert tuning.amount_thresholds(amounts).first()["high_value"] == 100000.0
    assert tuning.amount_thresholds(amounts.where("amount < 0")).first()["structuring"] == 1000.0


def test_kpis(spark):
    rows = [(i, "r", s, d, "open" if d is None else "closed", T0 + timedelta(days=i), T0 + timedelta(days=i + 2) if d else None) for i, (s, d) in enumerate([("high", "sar"), ("medium", "false_positive"), ("medium", None)])]
    a = spark.createDataFrame(rows, "id long, rule_id string, severity string, disposition string, status string, created_at timestamp, updated_at timestamp")
    k = reporting.kpi_summary(a, F.lit("2024-01-10").cast("timestamp")).first()
    assert (k["dispositioned"], k["sar_rate"], k["false_positive_rate"], k["avg_days_to_disposition"]) == (2, 0.5, 0.5, 2.0)
    assert reporting.kpi_summary(a.where("id > 9"), F.lit("2024-01-10").cast("timestamp")).first()["sar_rate"] == 0.0
    assert reporting.trend(a, F.lit("2024-01-10").cast("timestamp"), 30).count() == 30


def test_audit_chain(spark):
    with lifecycle.acting("ann", "run-1"):
        rows = lifecycle.chained([lifecycle.audit("x", "alert", i, T0, {"b": 1, "a": 2}) for i in range(4)])
    assert lifecycle.verified_chain(rows) == [] and rows[0]["prev_hash"] is None and rows[1]["actor"] == "ann"
    rows[2]["details"] = {}
    assert lifecycle.verified_chain(rows) == [2]
    assert lifecycle.verified_chain(rows[3:], rows[2]["row_hash"]) == []


def test_lifecycle(spark):
    cases = spark.createDataFrame([(1, "NEW", "LOW", None, None)], "id long, status string, priority string, assigned_to string, updated_at timestamp")
    now = F.lit("2024-01-10").cast("timestamp")
    out = lifecycle.update_case(cases, 1, now, status="INVESTIGATING", assigned_to="bo").first()
    assert out["status"] == "INVESTIGATING" and out["updated_at"] is not None
    with pytest.raises(ValueError):
        lifecycle.update_case(cases.withColumn("status", F.lit("CLOSED")), 1, now, status="NEW")
    logs = spark.createDataFrame([(1, "r", "run_rules", '{"last_processed_id": 5}'), (2, "r", "run_rules", '{"last_processed_id": 9}')], "id long, correlation_id string, action string, details_json string")
    assert lifecycle.last_processed(logs, "r") == 9 and lifecycle.last_processed(logs, "none") is None


def test_pages(spark):
    df, seen, cursor = spark.range(1, 26), [], None
    while True:
        rows, cursor = paging.next_cursor(paging.page(df, 10, cursor).collect(), 10)
        seen += [r["id"] for r in rows]
        if cursor is None:
            break
    assert seen == list(range(1, 26))
    with pytest.raises(ValueError):
        paging.decode_cursor("???")


def test_reports(spark):
    doc = reporting.sar_document({"case_id": 1, "total_amount": 5.0, "period_start": T0, "period_end": T0, "channels": ["a"], "rule_ids": None, "txn_count": 1, "account_ids": [3]}, {"name": "B & Co"})
    assert "<Name>B &amp; Co</Name>" in reporting.to_xml(doc)
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(reporting.audit_zip({"a": spark.range(2), "b": spark.range(0)}, {"n": 2})))
    assert sorted(z.namelist()) == ["a.csv", "a.json", "b.json", "summary.json"] and json.loads(z.read("a.json")) == [{"id": 0}, {"id": 1}]


def test_sliding_stats_of_an_account_in_pieces(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), T0 + timedelta(seconds=int(rng.integers(0, 400))), [0.1, 0.2, 0.3, 0.0, None][int(rng.integers(0, 5))], [None, "a", "b"][int(rng.integers(0, 3))]) for i in range(240)]
    # A sum from which others have been taken would leave a remainder for the last event.
    rows += [(900, 9, T0, 0.1, "a"), (901, 9, T0, 0.2, "a"), (902, 9, T0, 0.3, "a"), (903, 9, T0 + timedelta(seconds=61), 0.0, "a"), (904, 9, T0 + timedelta(seconds=200), None, None)]
    schema, folder, was = "event_id long, account_id long, ts timestamp, amount double, counterparty string", f"file://{tmp_path}/in", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(folder)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = pipeline.sliding_stats(spark.readStream.schema(schema).parquet(folder), 60)
        out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    got = {r["event_id"]: (r["n"], r["total"], r["counterparties"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert len(got) == len(rows)
    for i, account, ts, _, _ in rows:
        w = [r for r in rows if r[1] == account and ts - timedelta(seconds=60) <= r[2] <= ts]
        amounts = [r[3] for r in w if r[3] is not None]
        assert (got[i][0], got[i][2]) == (len(w), len({r[4] for r in w} - {None})), i
        assert got[i][1] == (pytest.approx(sum(amounts)) if amounts else None), i
    assert repr(got[903][1]) == "0.0"


def test_stream_rules_equal_the_batch(spark, tmp_path):
    from ledgerwatch.config import DEFAULTS
    from ledgerwatch.operators.rules import alerts_of
    from ledgerwatch.plans.rule_pack import scored

    folder = str(tmp_path / "in")
    lines = [json.dumps({"external_id": f"e{i}", "account_id": 1, "customer_id": 1, "ts": f"2024-01-01T10:0{i}:00+00:00", "amount": 20000.0 if i == 2 else 1.0, "base_risk": 10.0}) for i in range(6)]
    assert pipeline.publish(spark, [*lines, "junk", lines[0]], folder) == 7
    got = {}

    def sink(rows, alerts, number):
        got["alerts"] = {(r["transaction_id"], r["rule_id"]) for r in alerts.collect()}
        got["rows"] = rows.count()

    empty = lambda: spark.createDataFrame([], "id long, account_id long, customer_id long, ts timestamp, amount double, counterparty string, country string, base_risk double")
    q = pipeline.run_rules(pipeline.read_messages(spark, folder), empty, sink, DEFAULTS, str(tmp_path / "cp"))
    q.awaitTermination()
    assert got["rows"] == 6 and len(got["alerts"]) == 3
    batch = spark.read.schema(pipeline.MESSAGE).json(folder).dropDuplicates(["external_id"])
    batch = batch.withColumns({"id": F.xxhash64("external_id"), "ts": F.to_timestamp("ts")})
    assert {(r["transaction_id"], r["rule_id"]) for r in alerts_of(scored(batch, DEFAULTS)).collect()} == got["alerts"]


def test_bus():
    bus, seen = pipeline.Bus(), []
    bus.register(seen.append)
    bus.register(seen.append)
    bus.register(lambda e: 1 / 0)
    assert bus.emit({"a": 1}) == 1 and seen == [{"a": 1}]
