"""Ledger and graph analytics on PySpark."""
