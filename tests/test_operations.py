"""Runs, cases, registers, made-up ledgers, databases, redaction and sinks."""

import io
import json
import logging
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerwatch.config import DEFAULTS, merged
from ledgerwatch.functions import parsing, redaction, text
from ledgerwatch.operators import graph, lifecycle, paging, reporting, screening
from ledgerwatch.plans import run
from ledgerwatch.schemas import ACCOUNTS, CUSTOMERS, NAME_LIST, TRANSACTIONS
from ledgerwatch.sources import external, ledger_files, register, synthetic
from ledgerwatch.sources.store import Store

T0 = datetime(2024, 3, 1)


def clock():
    return T0 + timedelta(days=1)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.append("customers", spark.createDataFrame([(1, "A", "US", 5.0, T0), (2, "B", "US", 15.0, T0)], CUSTOMERS))
    s.append("accounts", spark.createDataFrame([(1, 1, "X1", T0), (2, 2, "X2", T0), (3, 2, "X3", T0)], ACCOUNTS))
    made = [(i, str(i), 1 + i % 3, T0 + timedelta(minutes=i), 20_000.0 if i % 5 == 0 else 10.0, "USD", None, "blocked shop" if i == 7 else "shop", "US", None, "out") for i in range(1, 24)]
    s.append("transactions", spark.createDataFrame([(*m, None, None, None, None, None) for m in made], TRANSACTIONS))
    return s


def alerts_of(store):
    rows = store.read("alerts").orderBy("id").collect()
    return [(r["id"], r["transaction_id"], r["rule_id"], r["score"], re.sub(r"\\s", "", r["evidence_fields"])) for r in rows]


def test_run_in_chunks_and_resumed(spark, store, tmp_path):
    config = merged(DEFAULTS, {"rules": {"network_ring": {"enabled": False}}})
    assert run.run_rules(store, config, clock, resume=None)[0] == 23
    whole = alerts_of(store)
    assert {w[2] for w in whole} >= {"HighValueTransaction", "SanctionsKeywordMatch", "RapidVelocity"} and [w[0] for w in whole] == list(range(1, len(whole) + 1))
    assert all(json.loads(w[4])["rule_hash"] for w in whole)
    scores = {r["id"]: (r["risk_score"], r["engine_version"]) for r in store.read("transactions").collect()}
    assert len(scores) == 23 and all(v is not None and e for v, e in scores.values())

    for name in ("alerts", "audit_logs"):
        store.replace(name, store.read(name).limit(0))
    with lifecycle.acting("me", "r1"):
        assert run.run_rules(store, config, clock, chunk=10) == (23, len(whole))
    assert alerts_of(store) == whole
    logs = store.read("audit_logs")
    assert [d["last_processed_id"] for d in run.details(logs)] == [10, 20, 23] and [d["chunk_index"] for d in run.details(logs)] == [0, 1, 2]
    assert {r["actor"] for r in logs.collect()} == {"me"} and reporting.chain_breaks(logs).count() == 0

    # The last two audit rows and half of the last chunk's alerts are lost with the run: nothing comes twice.
    store.replace("audit_logs", logs.where("id = 1"))
    store.replace("alerts", store.read("alerts").where(F.col("transaction_id") <= 15))
    left = store.read("alerts").count()
    done, new = run.run_rules(store, config, clock, chunk=10, resume="r1")
    assert (done, left + new) == (13, len(whole))
    assert sorted(a[1:] for a in alerts_of(store)) == sorted(w[1:] for w in whole)


def test_run_with_lists_and_rings(spark, store):
    listed = spark.createDataFrame([(0, "Blocked Shop", [], "organization", "custom", "US", None, "high", {})], NAME_LIST)
    config = merged(DEFAULTS, {"rules": {"sanctions_screening": {"enabled": True, "algorithms": ["exact", "levenshtein"]}}})
    hits = run.hits_of_run(run.in_context(store.read("transactions").drop("risk_score", "config_hash", "rules_version", "engine_version"), store.read("accounts"), store.read("customers")), config, clock(), listed, listed)
    found = {(r["id"], h["rule_id"], h["score_delta"]) for r in hits.select("id", F.explode("hits").alias("h")).collect() for h in [r["h"]]}
    assert {(i, d) for i, rule, d in found if rule == "SanctionsScreening"} == {(7, 30.0), (7, 24.0)}
    store.replace("transactions", store.read("transactions").limit(0))
    assert run.run_rules(store, config, clock) == (0, 0) and store.read("alerts").count() == 0


def test_one_name(spark):
    e = spark.createDataFrame([(0, "Juan Garcia", [], "individual", "custom", "ES", None, "high", {})], NAME_LIST)
    out = screening.screen_name("Juan Garcia", e, e).collect()
    assert [(r["list"], r["score"]) for r in out] == [("pep", 1.0), ("sanctions", 1.0)]
    assert screening.screen_name("", e, e).count() == 0


def test_sounds(spark):
    coded = {"knight": "NT", "wright": "RT", "phone": "FN", "school": "SKL", "church": "XRX", "judge": "JJ", "xavier": "SFR", "lamb": "LM", "nation": "NXN", "thing": "0NK", "aeon": "EN", "": ""}
    rows = spark.createDataFrame([(w,) for w in coded], "w string").select("w", text.metaphone(F.col("w")).alias("m")).collect()
    assert {r["w"]: r["m"] for r in rows} == coded
    pairs = spark.createDataFrame([("knight stone", "nite x"), ("smith", "smyth"), ("", "a"), ("\u8d75", "\u94b1"), ("abc", "")], "a string, b string")
    assert [r[0] for r in pairs.select(text.phonetic_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 0.0, 0.0]


def test_cases(store):
    with lifecycle.acting("me", "c1"):
        case = lifecycle.create_case(store, T0, [4, 5], [9], "look", "HIGH")
        lifecycle.change_case(store, case, T0, status="INVESTIGATING", assigned_to="you")
        with pytest.raises(ValueError):
            lifecycle.change_case(store, case, T0, status="NEW")
        with pytest.raises(KeyError):
            lifecycle.add_note(store, 99, "none", T0)
        with pytest.raises(ValueError):
            lifecycle.create_case(store, T0, priority="SOON")
    c = store.read("cases").collect()
    assert [(r["id"], r["status"], r["priority"], r["assigned_to"], r["actor"]) for r in c] == [(case, "INVESTIGATING", "HIGH", "you", "me")]
    items = store.read("case_items").orderBy("id").collect()
    assert [(r["alert_id"], r["transaction_id"]) for r in items] == [(4, None), (5, None), (None, 9)]
    assert [r["note"] for r in store.read("case_notes").collect()] == ["look"]
    logs = store.read("audit_logs").orderBy("id").collect()
    assert [r["action"] for r in logs] == ["case_create", *["case_item_add"] * 3, "case_note_add", "case_update"]
    assert json.loads(logs[-1]["details_json"]) == {"old_status": "NEW", "new_status": "INVESTIGATING", "old_assigned_to": None, "new_assigned_to": "you"}
    assert reporting.chain_breaks(store.read("audit_logs")).count() == 0


def test_register(spark):
    good = spark.createDataFrame([("a", "s", "high", 1)], "rule_id string, scenario_id string, severity string, more int")
    assert register.check_register(good) == [] and register.check_register(good.limit(0)) == ["no rows"]
    assert register.check_register(good.drop("severity", "rule_id")) == ["missing columns: rule_id, severity"]


def test_rejects(spark):
    raw = spark.createDataFrame([("", "2024-01-01", "1"), ("A", "soon", "1"), ("A", "2024-01-01", "2")], "iban string, ts string, amount string")
    rows = ledger_files.normalized(raw, {"iban": "iban_or_acct", "ts": "ts", "amount": "amount"})
    assert [r[0] for r in ledger_files.first_rejects(rows).collect()] == ["missing_iban", "parse_error:ValueError:Cannot parse datetime: soon"]
    assert ledger_files.first_rejects(rows, 1).count() == 1
    assert tuple(ledger_files.ingest_counts(rows, rows.limit(1)).first()) == (3, 2, 1)


def test_between(spark):
    df = spark.createDataFrame([(1, T0), (2, T0 + timedelta(days=1)), (3, None)], "id long, ts timestamp")
    ids = lambda *a: [r["id"] for r in paging.between(df, "ts", *a).orderBy("id").collect()]
    assert ids(T0, T0) == [1] and ids(None, T0 + timedelta(days=1)) == [1, 2] and ids() == [1, 2, 3] and ids(T0 + timedelta(days=2)) == []


def test_redaction(spark):
    lines = ["Name = Bob, amount=3", "counterparty: (x)", "surname=Y merchant=Z]", "", None]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(redaction.redacted(F.col("t"))).collect()]
    assert out[:-1] == [redaction.redacted_text(x) for x in lines[:-1]] and out[-1] is None
    assert out[0] == "Name=[REDACTED], amount=3" and out[2] == "surname=Y merchant=[REDACTED]]"
    record = logging.makeLogRecord({"msg": "iban_or_acct=%s", "args": ("X1",), "my_token": "t", "merchant": "m", "n": 3})
    assert redaction.Redaction().filter(record)
    assert (record.getMessage(), record.my_token, record.merchant, record.n) == ("iban_or_acct=[REDACTED]", "***", "[REDACTED]", 3)


def test_made_up_ledger_fires(spark):
    raw = synthetic.ledger(spark, 6_000, accounts=400).drop("pattern")
    assert raw.exceptAll(synthetic.ledger(spark, 6_000, accounts=400).drop("pattern")).isEmpty() and synthetic.ledger(spark, 0).count() == 0
    rows = ledger_files.normalized(raw, {c: c for c in raw.columns if c != "external_id"})
    assert rows.where("reject_reason is not null").isEmpty()
    empty = ledger_files.Tables(*[spark.createDataFrame([], s) for s in (CUSTOMERS, ACCOUNTS, TRANSACTIONS)])
    t = ledger_files.load(rows, empty, F.lit(T0))
    context = run.in_context(t.transactions.drop("risk_score", "config_hash", "rules_version", "engine_version"), t.accounts, t.customers)
    hits = run.hits_of_run(context, DEFAULTS, T0 + timedelta(days=30))
    fired = {r[0] for r in hits.select(F.explode("hits.rule_id")).distinct().collect()}
    assert fired >= {"RapidVelocity", "StructuringSmurfing", "GeoMismatch", "SanctionsKeywordMatch", "NetworkRingIndicator"}


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(100).select(F.col("id"), (F.col("id") * 2.5).alias("amount"))
    external.write_table(df, url, "t", mode="overwrite")
    back = external.read_table(spark, url, "t", key="id", parts=4)
    assert back.rdd.getNumPartitions() == 4 and back.agg(F.sum("amount")).first()[0] == 12375.0
    external.write_table(df.limit(0), url, "e", mode="overwrite")
    assert external.read_table(spark, url, "e", key="id").count() == 0


def test_messages(spark):
    m = external.messages(spark.createDataFrame([(3, "x")], "account_id long, counterparty string")).first()
    assert (m["key"], json.loads(m["value"])) == ("3", {"account_id": 3, "counterparty": "x"})


def test_replay(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text(f"line {i}\n")
    q = external.replay(spark, f"{tmp_path}/in", {"path": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/c"}, every="0 seconds")
    q.processAllAvailable()
    batches = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["line 0", "line 1", "line 2"] and batches == [1, 1, 1]


def test_filing():
    row = {"case_id": 4, "total_amount": 5.5, "period_start": T0, "period_end": None, "channels": ["wire"], "rule_ids": ["R"], "txn_count": 1, "account_ids": [3]}
    doc = reporting.sar_document(row, {"name": "Bank"}, "why", {"name": "S"}, "id-1", alert_ids=[7, 8], now=T0)
    xml = reporting.to_xml(doc)
    assert "<TotalAmount>5.50</TotalAmount>" in xml and "<AlertID>7</AlertID><AlertID>8</AlertID>" in xml and "DateRangeEnd" not in xml
    assert "<AccountNumbers><Account>3</Account></AccountNumbers>" in xml and 'xmlns="https://www.fincen.gov/bsa"' in xml


def test_sinks(spark, tmp_path):
    alerts = spark.createDataFrame([(1, 5, "R", "high", "why", "{}", T0, T0 + timedelta(hours=3)), (2, 5, "R", "low", "why", "{}", T0, None)], "id long, transaction_id long, rule_id string, severity string, reason string, evidence_fields string, created_at timestamp, updated_at timestamp")
    txns = spark.createDataFrame([(5, 9, T0, 2.0, "USD", "c", "US")], "id long, account_id long, ts timestamp, amount double, currency string, counterparty string, country string")
    reporting.write_sar_report(alerts, txns, f"file://{tmp_path}/r", T0)
    lines = [json.loads(r[0]) for r in spark.read.text(f"file://{tmp_path}/r/alerts.json").collect()]
    assert [(x["alert_id"], x["hours_to_disposition"], x["evidence"]) for x in lines] == [(1, 3.0, "{}"), (2, None, "{}")]
    assert len(spark.read.option("header", True).csv(f"file://{tmp_path}/r/alerts.csv").columns) == 14

    out = io.StringIO()
    graph.assembled({"nodes": spark.createDataFrame([('{"id":1}',), ('{"id":2}',)], "json string"), "links": spark.createDataFrame([], "json string")}, out)
    assert json.loads(out.getvalue()) == {"nodes": [{"id": 1}, {"id": 2}], "links": []}


def test_times_of_sinks_and_parsers_agree(spark):
    assert spark.range(1).select(parsing.csv_time(F.lit("2024-03-01T00:00:00Z"))).first()[0] == T0
