from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerwatch.config import DEFAULTS, check, config_hash, load, merged
from ledgerwatch.functions import scoring
from ledgerwatch.operators import rules
from ledgerwatch.plans import rule_pack

T0 = datetime(2024, 1, 1, 12)
SCHEMA = "id long, account_id long, customer_id long, ts timestamp, amount double, counterparty string, country string, base_risk double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def fired(df, config=DEFAULTS):
    return {r["id"]: [h["rule_id"] for h in r["hits"]] for r in rules.with_hits(df, config).collect()}


def test_golden_rows(spark):
    df = frame(spark, [
        (1, 1, 1, T0, 1000.0, None, "USA", 10.0), (2, 2, 2, T0, 500.0, "a Sanctioned firm", "IR", 10.0), (3, 3, 3, T0, 15000.0, "shop", "GB", 10.0),
    ])
    out = {r["id"]: (r["risk_score"], r["band"]) for r in rule_pack.scored(df, DEFAULTS).collect()}
    assert out == {1: (10.0, "low"), 2: (65.0, "medium"), 3: (35.0, "medium")}
    assert fired(df)[2] == ["SanctionsKeywordMatch", "HighRiskCountry"]


def test_structuring_and_band_edges(spark):
    df = frame(spark, [(i, 1, 1, T0 + timedelta(minutes=10 * i), 8550.0, None, None, 10.0) for i in range(3)])
    assert [len(v) for _, v in sorted(fired(df).items())] == [0, 0, 1]
    edge = frame(spark, [(i, 1, 1, T0 + timedelta(minutes=i), a, None, None, 10.0) for i, a in enumerate([7600.0, 9499.99, 9500.0, 7599.99])])
    assert not any("StructuringSmurfing" in v for v in fired(edge).values())


def test_velocity_counts_equal_times_for_one_another(spark):
    df = frame(spark, [(i, 1, 1, T0, 100.0, None, None, 10.0) for i in range(5)])
    assert all(v == ["RapidVelocity"] for v in fired(df).values())
    apart = frame(spark, [(i, 1, 1, T0 + timedelta(minutes=m), 100.0, None, None, 10.0) for i, m in enumerate([0, 3, 6, 9, 15])])
    assert fired(apart)[4] == ["RapidVelocity"]
    late = frame(spark, [(i, 1, 1, T0 + timedelta(minutes=m), 100.0, None, None, 10.0) for i, m in enumerate([0, 3, 6, 9, 15.1])])
    assert fired(late)[4] == []


def test_geo_is_by_customer_and_ignores_blank(spark):
    df = frame(spark, [(i, i, 1, T0 + timedelta(minutes=i), 1.0, None, c, 10.0) for i, c in enumerate(["US", "GB", "", "DE", None])])
    out = fired(df)
    assert out[3] == ["GeoMismatch"] and out[4] == [] and out[2] == []


def test_disabled_rules_leave_the_plan(spark):
    config = merged(DEFAULTS, {"rules": {n: {"enabled": False} for n in DEFAULTS["rules"]}})
    df = frame(spark, [(1, 1, 1, T0, 99999.0, "ofac", "IR", None)])
    assert fired(df, config) == {1: []}
    assert rule_pack.scored(df, config).first()["risk_score"] == 10.0


def test_no_python_in_the_pack(spark):
    df = rule_pack.scored(frame(spark, [(1, 1, 1, T0, 1.0, None, None, None)]), DEFAULTS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning(account_id") <= 1


def test_ring(spark):
    rows = [(i * 10 + k, i, i, T0, 10.0, f" Shared_{k} ", None, 10.0) for i in (1, 2, 3) for k in (0, 1)] + [(99, 4, 4, T0, 1.0, "alone", None, 10.0)]
    df = frame(spark, rows).withColumn("merchant", F.lit("m"))
    out = rule_pack.ring_hits(df, F.lit("2024-01-02").cast("timestamp"), DEFAULTS["rules"]["network_ring"]).collect()
    assert sorted(r["transaction_id"] for r in out) == [10, 20, 30]


def test_scores(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(scoring.clamped(F.lit(120.0))) == 100.0 and get(scoring.band(F.lit(33.0))) == "medium" and get(scoring.band(F.lit(66.0))) == "high"
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    for hours, want in ((24, 1.0), (24.1, 0.7), (168, 0.7), (720, 0.4), (721, 0.2)):
        assert get(scoring.decay(now - F.make_dt_interval(secs=F.lit(hours * 3600).cast("decimal(18,6)")), now)) == want
    assert get(scoring.severity_multiplier(F.lit("HIGH"))) == 1.5 and get(scoring.severity_multiplier(F.lit("other"))) == 1.0


def test_config(tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"rules": {"high_value": {"threshold": 5}}}')
    c = load([p, tmp_path / "none.json"], env={"LEDGERWATCH__scoring__low": "20"})
    assert c["rules"]["high_value"] == DEFAULTS["rules"]["high_value"] | {"threshold": 5} and c["scoring"]["low"] == 20
    assert config_hash(c) != config_hash(DEFAULTS) == config_hash(merged(DEFAULTS))
    try:
        check(merged(DEFAULTS, {"rules": {"high_risk_country": {"countries": ["XX"]}}}))
    except ValueError:
        return
    raise AssertionError
