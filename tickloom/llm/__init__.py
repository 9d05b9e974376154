"""Training-data operators: filters, deduplication, tokenising, scans.

Nothing outside this subpackage imports it.
"""
