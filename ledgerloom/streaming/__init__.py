"""Incremental processing: ledgers, upserts and event windows."""
