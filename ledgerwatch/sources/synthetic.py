"""Made-up ledgers of any size: every value is a hash of the row's number and the seed, so tasks need no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ("US", "GB", "DE", "FR", "ES", "IT", "NL", "CA")
CURRENCIES = ("USD", "EUR", "GBP")
CHANNELS = ("wire", "card", "ach", "cash")
DAY = 86_400
START = 1_704_067_200  # 2024-01-01
#: Rows out of PERIOD that belong to a pattern: five of velocity, three of structuring, four of countries, two of rings, one listed name.
PERIOD = 1_000
PATTERNS = (("velocity", 5), ("structuring", 3), ("countries", 4), ("ring", 2), ("listed", 1))


def _draw(name: str, seed: int, n: int) -> Column:
    return F.pmod(F.xxhash64("i", F.lit(f"{name}/{seed}")), F.lit(n))


def _one_of(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def ledger(spark: SparkSession, n: int, seed: int = 42, accounts: int | None = None, days: int = 90) -> DataFrame:
    """n transactions in canonical fields, and pattern: null for a plain one, else what it was planted for.

    Of each PERIOD rows the first ones form a group of one account per pattern: five small payments
    within ten minutes, three just below 9,500 within an hour, four countries within an hour, two
    counterparties of a ring of three accounts, one payment to a listed name.
    """
    accounts = accounts or max(10, n // 50)
    rows = spark.range(n).withColumnRenamed("id", "i").withColumns({"g": F.floor(F.col("i") / PERIOD), "p": F.col("i") % PERIOD})
    first, pattern, place = 0, F.lit(None).cast("string"), F.lit(0)
    for name, k in PATTERNS:
        here = F.col("p").between(first, first + k - 1)
        pattern, place = F.when(here, F.lit(name)).otherwise(pattern), F.when(here, F.col("p") - first).otherwise(place)
        first += k
    rows = rows.withColumns({"pattern": pattern, "place": place})
    planted, is_ = F.col("pattern").isNotNull(), lambda name: F.col("pattern") == name
    owner = F.when(planted, F.pmod(F.xxhash64("g", "pattern", F.lit(seed)), F.lit(accounts))).otherwise(_draw("account", seed, accounts))
    # Three groups after one another share a ring's two counterparties.
    owner = F.when(is_("ring"), F.pmod(F.col("g"), F.lit(accounts))).otherwise(owner)
    start = F.pmod(F.xxhash64("g", "pattern", F.lit(f"t/{seed}")), F.lit(days * DAY - 3_600))
    start = F.when(is_("ring"), F.lit((days - 1) * DAY) + F.col("g") % 3_000).otherwise(start)
    second = F.when(planted, start + F.col("place") * 120).otherwise(_draw("time", seed, days * DAY))
    # A product of two draws leaves many small amounts and few large ones.
    usual = F.round((1 + _draw("a", seed, 100)) * (1 + _draw("b", seed, 8_000)) / 100, 2)
    amount = F.when(is_("structuring"), F.lit(9_000.0) + F.col("place") * 100).when(planted, F.lit(100.0) + F.col("place")).otherwise(usual)
    other = F.concat(F.lit("Shop "), _draw("counterparty", seed, accounts).cast("string"))
    ring = F.concat(F.lit("Ring "), F.floor(F.col("g") / 3).cast("string"), F.lit("-"), F.col("place").cast("string"))
    home = _one_of(COUNTRIES, F.pmod(F.col("owner"), F.lit(len(COUNTRIES))))
    rows = rows.withColumns({"owner": owner, "second": second, "amount": amount})
    return rows.select(
        F.concat(F.lit("Customer "), F.col("owner").cast("string")).alias("customer_name"), home.alias("country"),
        F.format_string("ACC%08d", "owner").alias("iban_or_acct"), F.date_format(F.timestamp_seconds(START + F.col("second")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.col("amount").cast("string").alias("amount"), _one_of(CURRENCIES, _draw("currency", seed, 3)).alias("currency"),
        F.concat(F.lit("Merchant "), _draw("merchant", seed, 100).cast("string")).alias("merchant"),
        F.when(is_("ring"), ring).when(is_("listed"), F.lit("Sanctioned Trading")).otherwise(other).alias("counterparty"),
        F.when(is_("countries"), _one_of(COUNTRIES, F.col("place"))).otherwise(home).alias("country_txn"),
        _one_of(CHANNELS, _draw("channel", seed, 4)).alias("channel"), F.when(_draw("direction", seed, 10) < 7, "out").otherwise("in").alias("direction"),
        F.lit("medium").alias("base_risk"), F.concat(F.lit(f"{seed}-"), F.col("i").cast("string")).alias("external_id"), "pattern",
    )
