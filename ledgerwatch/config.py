"""Configuration: defaults, layered merging, checks and the hash that is stamped on results."""

from __future__ import annotations

import copy
import hashlib
import json
import os
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

# Rule parameters and score settings.
DEFAULTS: dict[str, Any] = {
    "ingest": {"batch_size": 500, "column_map": {}, "reject_reasons": 500},
    "scoring": {"base_risk": 10.0, "max_score": 100.0, "low": 33.0, "medium": 66.0, "profile": "balanced"},
    "rules": {
        "high_value": {"enabled": True, "threshold": 10000.0, "severity": "high", "score_delta": 25.0},
        "rapid_velocity": {"enabled": True, "min_transactions": 5, "window_minutes": 15, "severity": "medium", "score_delta": 20.0},
        "geo_mismatch": {"enabled": True, "max_countries": 2, "window_minutes": 60, "severity": "medium", "score_delta": 15.0},
        "structuring": {
            "enabled": True, "threshold": 9500.0, "min_transactions": 3, "window_minutes": 60, "severity": "high", "score_delta": 30.0,
        },
        "sanctions_keyword": {
            "enabled": True, "keywords": ["sanctioned", "ofac", "blocked", "restricted"], "severity": "high", "score_delta": 30.0,
            "list_version": "1.0", "effective_date": "2026-01-01",
        },
        "high_risk_country": {
            "enabled": True, "countries": ["IR", "KP", "SY"], "severity": "high", "score_delta": 25.0,
            "list_version": "1.0", "effective_date": "2026-01-01",
        },
        "network_ring": {
            "enabled": True, "min_shared": 2, "min_linked": 2, "lookback_days": 30, "severity": "high", "score_delta": 40.0,
        },
        "sanctions_screening": {
            "enabled": False, "threshold": 0.85, "pep_threshold": 0.8, "algorithms": ["exact", "levenshtein", "jaro_winkler", "phonetic"],
            "score_delta": 30.0, "keywords": [],
        },
        "ml_anomaly": {"enabled": False, "threshold": 0.7, "severity": "medium", "score_delta": 20.0},
    },
    "regulation": "fincen",
}

#: Country codes that stand for "fill this in".
PLACEHOLDERS = frozenset({"XX", "YY"})


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Later layers over earlier ones; nested mappings merge, all else is replaced."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            both = isinstance(v, Mapping) and isinstance(out.get(k), Mapping)
            out[k] = merged(out[k], v) if both else copy.deepcopy(v)
    return out


def _read(path: str | Path) -> dict[str, Any]:
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def load(files: Iterable[str | Path] = (), overrides: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Defaults, then files in order (those that exist), then LEDGERWATCH__a__b variables, then overrides; checked."""
    layers = [DEFAULTS, *(_read(f) for f in files if Path(f).exists())]
    for k, v in sorted((os.environ if env is None else env).items()):
        if k.startswith("LEDGERWATCH__"):
            value: Any = v
            try:
                value = json.loads(v)
            except ValueError:
                pass
            for part in reversed(k.split("__")[1:]):
                value = {part.lower(): value}
            layers.append(value)
    out = merged(*layers, overrides or {})
    check(out)
    return out


def check(config: Mapping[str, Any]) -> None:
    """Refuses placeholder countries and thresholds that can't work."""
    rule = config["rules"]["high_risk_country"]
    left = PLACEHOLDERS & {str(c).upper() for c in rule["countries"]}
    if rule.get("enabled", True) and left:
        raise ValueError(f"high_risk_country has placeholder countries: {', '.join(sorted(left))}")
    s = config["scoring"]
    if not 0 <= s["low"] <= s["medium"] <= s["max_score"]:
        raise ValueError("scoring bands must rise from 0 to max_score")


def config_hash(config: Mapping[str, Any]) -> str:
    """SHA-256 of the configuration with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
