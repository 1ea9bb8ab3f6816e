"""Training-data operators: filters, deduplication, extraction, mixing, encoding.

Nothing outside this subpackage imports it.
"""
