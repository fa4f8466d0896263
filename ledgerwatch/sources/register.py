"""The register of detection rules: a CSV file that names each rule with its scenario."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

# Columns that a register must have.
REQUIRED = ("rule_id", "scenario_id", "severity")


def missing_columns(have: Iterable[str], required: Iterable[str] = REQUIRED) -> list[str]:
    return sorted(set(required) - set(have))


def check_register(register: DataFrame) -> list[str]:
    """What is wrong with a register; empty if nothing is."""
    if missing := missing_columns(register.columns):
        return [f"missing columns: {', '.join(missing)}"]
    return ["no rows"] if register.isEmpty() else []
