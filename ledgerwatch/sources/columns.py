"""Mapping of foreign headers to canonical fields, and its sidecar file."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from pathlib import Path

REQUIRED = ("iban_or_acct", "ts")
FIELDS = (
    "iban_or_acct", "ts", "amount", "currency", "customer_name", "country", "country_txn", "merchant", "counterparty", "channel", "direction", "base_risk",
)

# Headers that name a transaction's own id.
ID_HEADERS = ("transaction_id", "id", "txn_id", "transaction_uuid", "external_id", "txn_ref", "txnref", "ref")

# Normalised headers that stand for a field; the first that is there wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "iban_or_acct": (
        "iban_or_acct", "iban", "account_id", "account_number", "acct_id", "account", "acc_id", "acct_no", "acctno", "account_no",
    ),
    "ts": (
        "ts", "timestamp", "date", "value_date", "booking_date", "transaction_date", "created_at", "event_timestamp", "event_date",
        "event_time", "settlement_date", "settlementdate", "eventdate", "eventtime",
    ),
    "amount": (
        "amount", "transaction_amount", "value", "amt", "sum", "total", "amount_minor_units", "amount_minor", "minor_units", "amountminorunits",
    ),
    "currency": ("currency", "currency_code", "ccy", "curr", "currency_iso", "ccy_alpha", "ccyalpha"),
    "customer_name": ("customer_name", "customer", "name", "account_holder", "holder_name", "acct_holder", "accountholder", "acctholder"),
    "country": (
        "country", "origin_country", "customer_country", "home_country", "country_code", "residence_country", "geo_origin", "geoorigin",
    ),
    "country_txn": (
        "country_txn", "destination_country", "merchant_country", "counterparty_country", "txn_country", "geo_destination", "geodestination",
    ),
    "merchant": ("merchant", "merchant_name", "payee", "beneficiary_name", "merchant_id", "narrative"),
    "counterparty": (
        "counterparty", "counterparty_name", "counterparty_id", "counter_party", "beneficiary", "payer", "beneficiary_name",
        "beneficiary_ref", "remitter_ref", "beneficiaryname", "beneficiaryref", "remitterref",
    ),
    "channel": ("channel", "channel_type", "channel_name", "entry_channel", "entry_code", "device_type", "auth_method"),
    "direction": ("direction", "debit_credit", "flow", "dr_cr", "type_direction"),
    "base_risk": ("base_risk", "risk_band", "risk_score", "risk_level", "customer_risk", "risk_tier", "risktier"),
}


def normalized_header(header: str) -> str:
    return re.sub(r"[\s._-]+", "_", str(header).strip().lower()).strip("_")


def infer(headers: Iterable[str], chosen: Mapping[str, str] | None = None) -> dict[str, str]:
    """{header: field}. Chosen pairs come first; then for each field the first alias present, unless its header is taken."""
    there: dict[str, str] = {}
    for h in headers:
        there.setdefault(normalized_header(h), h)
    out: dict[str, str] = {}
    for h, field in (chosen or {}).items():
        if field in FIELDS and normalized_header(h) in there:
            out[there[normalized_header(h)]] = field
    for field, aliases in ALIASES.items():
        if field in out.values():
            continue
        header = next((there[a] for a in aliases if a in there), None)
        if header is not None and header not in out:
            out[header] = field
    return out


def id_header(headers: Iterable[str]) -> str | None:
    headers = set(headers)
    return next((h for h in ID_HEADERS if h in headers), None)


def missing(mapping: Mapping[str, str]) -> list[str]:
    return [f for f in REQUIRED if f not in mapping.values()]


def sidecar(path: str) -> Path:
    """The file beside a data file that keeps its mapping."""
    p = Path(path)
    return p.with_name(f"{p.stem}.schema.json")


def save_sidecar(path: str, mapping: Mapping[str, str]) -> Path:
    out = sidecar(path)
    out.write_text(json.dumps({"column_map": dict(mapping)}, indent=2, sort_keys=True))
    return out


def load_sidecar(path: str) -> dict[str, str] | None:
    p = sidecar(path)
    if not p.exists():
        return None
    data = json.loads(p.read_text())
    return {str(k): str(v) for k, v in data.get("column_map", data).items()}


def resolve(headers: Iterable[str], config_map: Mapping[str, str] | None = None, path: str | None = None) -> dict[str, str]:
    """The configured map, else the sidecar's, else inference alone; refuses one without the required fields."""
    headers = list(headers)
    chosen = dict(config_map or {}) or (load_sidecar(path) if path else None)
    out = infer(headers, chosen)
    if lacking := missing(out):
        raise ValueError(f"no column for {', '.join(lacking)} among {', '.join(headers)}")
    return out
