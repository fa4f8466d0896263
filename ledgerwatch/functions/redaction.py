"""Names and account numbers kept out of logs and of texts."""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of fields that logs don't show.
SECRET_FIELDS = ("password", "secret", "token", "api_key", "authorization")
PERSONAL_FIELDS = ("iban_or_acct", "customer_name", "name", "metadata_json", "counterparty", "merchant", "external_id", "reason")
SECRET_MASK, PERSONAL_MASK = "***", "[REDACTED]"

#: A personal field's name, a separator and the value behind it.
PATTERN = rf"(?i)(\b(?:{'|'.join(PERSONAL_FIELDS)}))[\s=:]+[^\s,)\]]+"
_PATTERN = re.compile(PATTERN)


def redacted(text: Column) -> Column:
    """text with the values behind personal fields' names masked; null stays null."""
    return F.regexp_replace(text.cast("string"), PATTERN, f"$1={PERSONAL_MASK}")


def redacted_text(text: Any) -> str:
    """redacted() of one value."""
    return _PATTERN.sub(rf"\1={PERSONAL_MASK}", text if isinstance(text, str) else str(text))


def redacted_fields(fields: Mapping[str, Any]) -> dict[str, Any]:
    """fields with those masked whose name holds a secret's or a personal field's name."""
    has = lambda k, names: any(n in k.lower() for n in names)
    return {k: SECRET_MASK if has(k, SECRET_FIELDS) else PERSONAL_MASK if has(k, PERSONAL_FIELDS) else v for k, v in fields.items()}


class Redaction(logging.Filter):
    """Masks the message of every log record, and the personal fields that were added to it."""

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = redacted_text(record.getMessage()), ()
        own = vars(logging.makeLogRecord({}))
        vars(record).update(redacted_fields({k: v for k, v in vars(record).items() if k not in own}))
        return True
