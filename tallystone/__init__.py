"""Tallystone: ledger analytics and corpus operators declared on PySpark."""

__version__ = "0.1.0"
