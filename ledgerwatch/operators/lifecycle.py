"""Alerts, cases and the audit log: changes as new frames, with hash-chained audit rows."""

from __future__ import annotations

import contextvars
import hashlib
import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.schemas import AUDIT_LOGS, TABLES
from ledgerwatch.sources.store import Store

# States and the moves between them.
CASE_MOVES: dict[str, tuple[str, ...]] = {
    "NEW": ("INVESTIGATING", "ESCALATED", "CLOSED"), "INVESTIGATING": ("ESCALATED", "CLOSED"), "ESCALATED": ("CLOSED",), "CLOSED": (),
}
PRIORITIES = ("LOW", "MEDIUM", "HIGH")
ALERT_STATES = ("open", "closed")
DISPOSITIONS = ("false_positive", "escalate", "sar")

_run = contextvars.ContextVar("correlation_id", default=None)
_actor = contextvars.ContextVar("actor", default="system")


@contextmanager
def acting(actor: str = "system", correlation_id: str | None = None):
    """Sets who acts, and in which run, for audit rows made inside."""
    a, b = _actor.set(actor), _run.set(correlation_id or uuid.uuid4().hex)
    try:
        yield _run.get()
    finally:
        _actor.reset(a)
        _run.reset(b)


def current_actor() -> str:
    return _actor.get()


def current_run() -> str | None:
    return _run.get()


def may_move(old: str, new: str) -> bool:
    return new in CASE_MOVES.get(old, ())


def check_move(old: str, new: str) -> None:
    if not may_move(old, new):
        raise ValueError(f"a case can't go from {old} to {new}")


def allowed(old: Column, new: Column) -> Column:
    """may_move over columns."""
    moves = F.create_map(*[x for k, v in CASE_MOVES.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(moves, old), new), F.lit(False))


def update_alert(alerts: DataFrame, id_: int, now: Column, status: str | None = None, disposition: str | None = None) -> DataFrame:
    """alerts with one row's status and disposition changed."""
    if status is not None and status not in ALERT_STATES:
        raise ValueError(f"status must be one of {', '.join(ALERT_STATES)}")
    if disposition is not None and disposition not in DISPOSITIONS:
        raise ValueError(f"disposition must be one of {', '.join(DISPOSITIONS)}")
    mine = F.col("id") == id_
    new = {"updated_at": F.when(mine, now).otherwise(F.col("updated_at"))}
    for c, v in (("status", status), ("disposition", disposition)):
        if v is not None:
            new[c] = F.when(mine, F.lit(v)).otherwise(F.col(c))
    return alerts.withColumns(new)


def update_case(cases: DataFrame, id_: int, now: Column, **changes: Any) -> DataFrame:
    """cases with one row changed; a move that isn't allowed is refused."""
    mine = F.col("id") == id_
    if "status" in changes:
        old = cases.where(mine).select("status").first()
        if old is None:
            raise KeyError(id_)
        check_move(old[0], changes["status"])
    if changes.get("priority") not in (None, *PRIORITIES):
        raise ValueError(f"priority must be one of {', '.join(PRIORITIES)}")
    new = {c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}
    return cases.withColumns({**new, "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))})


def canonical(row: Mapping[str, Any]) -> str:
    """What is hashed of an audit row."""
    ts = row["ts"]
    when = ts.astimezone(timezone.utc).isoformat() if isinstance(ts, datetime) and ts.tzinfo else ts.isoformat() if isinstance(ts, datetime) else str(ts)
    details = json.dumps(row.get("details") or {}, sort_keys=True, default=str)
    return "|".join(str(x if x is not None else "") for x in (row.get("correlation_id"), row["action"], row["entity_type"], row["entity_id"], when, row["actor"], details))


def chained(rows: Iterable[Mapping[str, Any]], last_hash: str | None = None) -> list[dict[str, Any]]:
    """Audit rows with prev_hash and row_hash, in order, behind last_hash."""
    out = []
    for r in rows:
        h = hashlib.sha256(((last_hash or "") + canonical(r)).encode()).hexdigest()
        out.append({**r, "prev_hash": last_hash, "row_hash": h})
        last_hash = h
    return out


def audit(action: str, entity_type: str, entity_id: Any, ts: datetime, details: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """An audit row of the current actor and run."""
    return {"correlation_id": _run.get(), "action": action, "entity_type": entity_type, "entity_id": str(entity_id), "ts": ts, "actor": _actor.get(), "details": dict(details or {})}


def log(store: Store, rows: Sequence[Mapping[str, Any]]) -> None:
    """Appends audit rows to the store's log, chained behind its last row. One writer at a time, as ids and hashes follow one another."""
    logs = store.read("audit_logs")
    last = logs.agg(F.max("id"), F.max_by("row_hash", "id")).first()
    out = []
    for i, r in enumerate(chained(rows, last[1]), (last[0] or 0) + 1):
        out.append({**{k: v for k, v in r.items() if k != "details"}, "id": i, "details_json": json.dumps(r["details"], sort_keys=True, default=str)})
    spark = logs.sparkSession
    store.append("audit_logs", spark.createDataFrame([tuple(r.get(c) for c in logs.columns) for r in out], AUDIT_LOGS))


def _add(store: Store, name: str, rows: list[dict[str, Any]]) -> list[int]:
    """Appends rows to a table under new ids; returns the ids."""
    there = store.read(name)
    top = there.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ids = list(range(top + 1, top + 1 + len(rows)))
    if rows:
        store.append(name, there.sparkSession.createDataFrame([tuple({**r, "id": i}.get(c) for c in there.columns) for i, r in zip(ids, rows, strict=True)], TABLES[name]))
    return ids


def create_case(
    store: Store, now: datetime, alert_ids: Sequence[int] = (), transaction_ids: Sequence[int] = (), note: str | None = None,
    priority: str = "MEDIUM", assigned_to: str | None = None,
) -> int:
    """A new case with items and a first note, each with its audit row; returns its id."""
    if priority not in PRIORITIES:
        raise ValueError(f"priority must be one of {', '.join(PRIORITIES)}")
    who = {"created_at": now, "correlation_id": _run.get(), "actor": _actor.get()}
    (case,) = _add(store, "cases", [{**who, "status": "NEW", "priority": priority, "assigned_to": assigned_to}])
    held = [{"alert_id": a} for a in alert_ids] + [{"transaction_id": t} for t in transaction_ids]
    items = _add(store, "case_items", [{**h, "case_id": case, "created_at": now} for h in held])
    rows = [audit("case_create", "case", case, now, {"priority": priority})]
    rows += [audit("case_item_add", "case", case, now, {"case_item_id": i, **h}) for i, h in zip(items, held, strict=True)]
    log(store, rows)
    if note:
        add_note(store, case, note, now)
    return case


def add_note(store: Store, case: int, note: str, now: datetime) -> int:
    """A note on a case that is there, with its audit row; returns the note's id."""
    if store.read("cases").where(F.col("id") == case).isEmpty():
        raise KeyError(case)
    (id_,) = _add(store, "case_notes", [{"case_id": case, "note": note, "created_at": now, "actor": _actor.get(), "correlation_id": _run.get()}])
    log(store, [audit("case_note_add", "case", case, now, {"case_note_id": id_})])
    return id_


def change_case(store: Store, case: int, now: datetime, **changes: Any) -> None:
    """update_case() in the store, with an audit row of old and new values."""
    cases = store.read("cases")
    old = cases.where(F.col("id") == case).first()
    if old is None:
        raise KeyError(case)
    store.replace("cases", update_case(cases, case, F.lit(now), **changes, correlation_id=_run.get(), actor=_actor.get()).select(*cases.columns))
    log(store, [audit("case_update", "case", case, now, {f"{w}_{k}": v for k, new in changes.items() for w, v in (("old", old[k]), ("new", new))})])


def verified_chain(rows: Iterable[Mapping[str, Any]], seed: str | None = None) -> list[int]:
    """Places of rows whose link or hash is wrong; the first row must follow seed."""
    bad, last = [], seed
    for i, r in enumerate(rows):
        if r["prev_hash"] != last or r["row_hash"] != hashlib.sha256(((last or "") + canonical(r)).encode()).hexdigest():
            bad.append(i)
        last = r["row_hash"]
    return bad


def last_processed(logs: DataFrame, correlation_id: str) -> int | None:
    """The id that a run got to, from its latest audit row; None if it has none."""
    row = (
        logs.where((F.col("correlation_id") == correlation_id) & (F.col("action") == "run_rules"))
        .agg(F.max_by(F.get_json_object("details_json", "$.last_processed_id"), "id")).first()
    )
    return None if row is None or row[0] is None else int(row[0])
