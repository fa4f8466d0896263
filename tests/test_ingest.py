from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions import parsing
from ledgerwatch.schemas import ACCOUNTS, CUSTOMERS, TRANSACTIONS
from ledgerwatch.sources import columns, ledger_files, name_lists
from ledgerwatch.sources.store import Store


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("2024-1-5T3:04:05.678Z", datetime(2024, 1, 5, 3, 4, 5)), ("2024-01-05 03:04:05.25", datetime(2024, 1, 5, 3, 4, 5, 250000)),
    ("2024-01-05", datetime(2024, 1, 5)), ("20240105", datetime(2024, 1, 5)), ("20240105030405", datetime(2024, 1, 5, 3, 4, 5)),
    ("5/1/2024", datetime(2024, 1, 5)), ("1/25/2024", datetime(2024, 1, 25)), ("5-1-2024 03:04:05", datetime(2024, 1, 5, 3, 4, 5)),
    ("2024-01-05T03:04:05+00:00", None), ("soon", None), (None, None),
])
def test_csv_times(spark, text, want):
    assert one(spark, text, parsing.csv_time) == want


@pytest.mark.parametrize(("text", "want"), [("$1,234.50", 1234.5), ("12 EUR", 12.0), ("", 0.0), (None, 0.0), ("-3", -3.0), ("much", None), ("1e3", 1000.0)])
def test_amounts(spark, text, want):
    assert one(spark, text, parsing.amount) == want


@pytest.mark.parametrize(("text", "want"), [("low", 5.0), ("1", 5.0), ("M", 15.0), ("H", 25.0), ("42", 42.0), ("odd", 10.0), (None, 10.0)])
def test_risk_bands(spark, text, want):
    assert one(spark, text, parsing.base_risk) == want


def test_column_map():
    headers = ["transaction_id", "timestamp", "account_id", "customer_name", "amount", "Risk Band", "merchant_name", "origin_country", "destination_country"]
    m = columns.resolve(headers)
    assert m == {
        "account_id": "iban_or_acct", "timestamp": "ts", "amount": "amount", "customer_name": "customer_name", "origin_country": "country",
        "destination_country": "country_txn", "merchant_name": "merchant", "Risk Band": "base_risk",
    }
    assert columns.id_header(headers) == "transaction_id"
    with pytest.raises(ValueError):
        columns.resolve(["amount"])


def test_a_taken_header_leaves_the_field_out():
    m = columns.infer(["beneficiary_name", "iban", "ts", "remitter_ref"])
    assert m["beneficiary_name"] == "merchant" and "counterparty" not in m.values()


def test_dirty_csv(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text('iban,ts,amount,counterparty\nA,2024-01-01,5,"x, y"\n ,2024-01-01,5,x\nB,never,5,x\nC,2024-01-01,abc,x\n')
    raw = ledger_files.read_csv(spark, str(p))
    rows = ledger_files.normalized(raw, columns.resolve(raw.columns))
    good, bad = ledger_files.split_rejects(rows)
    assert [r["counterparty"] for r in good.collect()] == ["x, y"] and bad.count() == 3
    assert {r["reason"]: r["n"] for r in ledger_files.reject_summary(rows).collect()} == {"missing_iban": 1, "parse_error:ValueError": 2}
    assert ledger_files.discover(spark, str(p), save=True)["iban"] == "iban_or_acct" and columns.load_sidecar(str(p))["ts"] == "ts"


def test_jsonl(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"iban_or_acct": "A", "ts": "2024-01-01T00:00:00Z", "amount": 5, "country": "GB"}\n{}\nnot json\n')
    raw = ledger_files.read_jsonl(spark, str(p))
    good, bad = ledger_files.split_rejects(ledger_files.normalized(raw, {f: f for f in columns.FIELDS}, json_lines=True))
    assert [(r["iban_or_acct"], r["country_txn"]) for r in good.collect()] == [("A", "GB")] and bad.count() == 2


def test_external_id_is_stable_over_case_and_space(spark):
    rows = [(1, datetime(2024, 1, 1), 2.675, "usd", " Shop ", "OUT"), (1, datetime(2024, 1, 1), 2.68, "USD", "shop", "out"), (1, datetime(2024, 1, 1), 2.69, "USD", "shop", "out")]
    df = spark.createDataFrame(rows, "a long, t timestamp, m double, c string, p string, d string")
    ids = [r[0] for r in df.select(parsing.external_id(*[F.col(c) for c in "atmcpd"])).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64


def test_load_twice_adds_nothing(spark):
    rows = spark.createDataFrame(
        [("Ann", "GB", "A", datetime(2024, 1, d), 5.0, "USD", None, "x", "GB", None, "out", 10.0, None) for d in (1, 2, 2)],
        "customer_name string, country string, iban_or_acct string, ts timestamp, amount double, currency string, merchant string, counterparty string, "
        "country_txn string, channel string, direction string, base_risk double, source_id string",
    )
    empty = ledger_files.Tables(*[spark.createDataFrame([], s) for s in (CUSTOMERS, ACCOUNTS, TRANSACTIONS)])
    now = F.lit("2024-02-01").cast("timestamp")
    first = ledger_files.load(rows, empty, now)
    again = ledger_files.load(rows, first, now)
    assert first.transactions.count() == again.transactions.count() == 2 and again.accounts.count() == 1


def test_name_lists(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("ent_num,SDN_Name,sdn_type,country,aliases\n1,John Doe,individual,IR,J. Doe| Johnny \n")
    b.write_text('7,"ACME, Ltd",-0- ,X,-0- ,,,,,,,note\n')
    (r,), (h,) = name_lists.read_sdn(spark, str(a)).collect(), name_lists.read_sdn(spark, str(b)).collect()
    assert r["aliases"] == ["J. Doe", "Johnny"] and r["entity_type"] == "individual"
    assert h["name"] == "ACME, Ltd" and h["entity_type"] == "organization" and h["extra"]["remarks"] == "note"


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    assert s.read("accounts").count() == 0
    df = spark.createDataFrame([(1, 1, "A", None), (2, 2, "B", None)], ACCOUNTS)
    s.append("accounts", df)
    s.append("accounts", df.where("id = 1").withColumn("id", F.lit(3).cast("bigint")))
    s.upsert("accounts", df.where("id = 2").withColumn("iban_or_acct", F.lit("Z")), ["id"])
    assert {r["id"]: r["iban_or_acct"] for r in s.read("accounts").collect()} == {1: "A", 2: "Z", 3: "A"}
