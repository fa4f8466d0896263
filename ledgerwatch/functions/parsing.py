"""Parsers of ledger fields as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwatch.functions.text import stripped

# Accepted forms of a time, in the order in which they are tried.
CSV_TIMES = (
    "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d", "yyyyMMdd", "yyyyMMddHHmmss",
    "yyyyMMdd HHmmss", "d/M/yyyy H:m:s", "d/M/yyyy", "M/d/yyyy H:m:s", "M/d/yyyy", "d-M-yyyy H:m:s", "d-M-yyyy",
)
JSON_TIMES = ("yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d H:m:s", "yyyy-M-d")


def first_time(text: Column, forms: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


_DIGITS = {"yyyy": r"\d{4}", "MM": r"\d\d", "dd": r"\d\d", "HH": r"\d\d", "mm": r"\d\d", "ss": r"\d\d", "SSSSSS": r"\d{6}"}


def _shape(form: str) -> str:
    """The pattern of the texts that a form may fit."""
    parts = re.findall(r"y+|M+|d+|H+|m+|s+|S+|'[^']*'|.", form)
    return "".join(_DIGITS.get(p, r"\d{1,2}" if p in "MdHms" else re.escape(p.strip("'"))) for p in parts)


def csv_time(c: Column) -> Column:
    """Without Z, and behind a T without fractions of a second; null where no form fits.

    A text's shape tells the forms that it may have, mostly one, so that parsers don't
    run on what they can't read.
    """
    s = stripped(F.translate(c.cast("string"), "Zz", ""))
    short = F.when(s.contains("T") & s.contains("."), F.substring_index(s, ".", 1)).otherwise(s)
    # A fraction may have one to six digits.
    tail = F.rpad(F.regexp_extract(s, r"\.(\d{1,6})$", 1), 6, "0")
    text = F.when(short.contains(".") & short.rlike(r":\d{1,2}\.\d{1,6}$"), F.concat(F.regexp_replace(s, r"\.\d{1,6}$", "."), tail)).otherwise(short)
    forms: dict[str, list[str]] = {}
    for f in CSV_TIMES:
        forms.setdefault(_shape(f), []).append(f)

    def parsed(t: Column) -> Column:
        out = F.lit(None).cast("timestamp")
        for shape, fs in reversed(forms.items()):
            out = F.when(t.rlike(f"^{shape}$"), F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in fs])).otherwise(out)
        return out

    # As the one element of an array, the text is made once and not for each branch.
    return F.get(F.transform(F.array(text), parsed), F.lit(0))


def json_time(c: Column) -> Column:
    return first_time(stripped(c), JSON_TIMES)


def epoch_time(c: Column) -> Column:
    """Numeric times: seconds, or milliseconds above 1e12."""
    n = c.cast("double")
    return F.timestamp_micros(F.when(n > 1e12, n * 1e3).otherwise(n * 1e6).cast("bigint"))


def stream_time(c: Column, otherwise: Column) -> Column:
    """ISO times with any offset; where they can't be read, the given time."""
    return F.coalesce(F.try_to_timestamp(stripped(c)), otherwise)


def amount(c: Column, minor_units: bool = False) -> Column:
    """Number without separators and currency marks; blank is 0, null where it can't be read."""
    s = F.coalesce(F.regexp_replace(c.cast("string"), r"[,\s]", ""), F.lit(""))
    s = F.regexp_replace(s, r"^(?:[$£€]|USD|GBP|EUR)+|(?:[$£€]|USD|GBP|EUR)+$", "")
    n = F.when(s == "", F.lit(0.0)).otherwise(F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double")))
    return n / 100 if minor_units else n


def base_risk(c: Column, default: float = 10.0) -> Column:
    """Bands low, medium and high, or a number."""
    s = F.lower(stripped(c))
    return (
        F.when(s.isin("low", "l", "1"), 5.0).when(s.isin("medium", "med", "m", "2"), 15.0).when(s.isin("high", "h", "3"), 25.0)
        .otherwise(F.coalesce(s.try_cast("double"), F.lit(float(default))))
    )


def iso_utc(ts: Column) -> Column:
    """ISO time in UTC; microseconds only where there are any."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def external_id(account_id: Column, ts: Column, amount: Column, currency: Column, counterparty: Column, direction: Column) -> Column:
    """SHA-256 over the normalised fields of a transaction, so that a repeated one is known again."""
    # Half to even on the shortest decimal form of the amount.
    two = F.bround(amount.cast("string").cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string")
    low = lambda c: F.lower(F.coalesce(stripped(c), F.lit("")))
    parts = (account_id.cast("string"), iso_utc(ts), two, F.upper(F.coalesce(stripped(currency), F.lit(""))), low(counterparty), low(direction))
    return F.sha2(F.concat_ws("|", *parts), 256)
