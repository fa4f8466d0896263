"""Table schemas."""

from __future__ import annotations

CUSTOMERS = "id long, name string, country string, base_risk double, created_at timestamp"
ACCOUNTS = "id long, customer_id long, iban_or_acct string, created_at timestamp"
TRANSACTIONS = (
    "id long, external_id string, account_id long, ts timestamp, amount double, currency string, merchant string, "
    "counterparty string, country string, channel string, direction string, metadata_json string, risk_score double, "
    "config_hash string, rules_version string, engine_version string"
)
ALERTS = (
    "id long, transaction_id long, rule_id string, severity string, score double, reason string, evidence_fields string, "
    "config_hash string, rules_version string, engine_version string, correlation_id string, status string, "
    "disposition string, created_at timestamp, updated_at timestamp"
)
CASES = "id long, status string, priority string, assigned_to string, created_at timestamp, updated_at timestamp, correlation_id string, actor string"
CASE_ITEMS = "id long, case_id long, alert_id long, transaction_id long, created_at timestamp"
CASE_NOTES = "id long, case_id long, note string, created_at timestamp, actor string, correlation_id string"
EDGES = "src_type string, src_id long, dst_type string, dst_key string, first_seen_at timestamp, last_seen_at timestamp, txn_count long"
AUDIT_LOGS = (
    "id long, correlation_id string, action string, entity_type string, entity_id string, ts timestamp, actor string, "
    "details_json string, prev_hash string, row_hash string"
)
NAME_LIST = "entry_id long, name string, aliases array<string>, entity_type string, source string, country string, list_date string, risk_level string, extra map<string,string>"

TABLES = {
    "customers": CUSTOMERS, "accounts": ACCOUNTS, "transactions": TRANSACTIONS, "alerts": ALERTS, "cases": CASES,
    "case_items": CASE_ITEMS, "case_notes": CASE_NOTES, "relationship_edges": EDGES, "audit_logs": AUDIT_LOGS,
}
