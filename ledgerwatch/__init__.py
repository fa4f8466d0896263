"""ledgerwatch: transaction monitoring over ledgers as Spark plans."""

__version__ = "0.1.0"
RULES_VERSION = "1.0.0"
