"""Operators for preparing training text: filters, deduplication, scans, tokenisation and scoring."""
