"""Operators for preparing training text: scoring, filtering, deduplication, tokens and packing.

Nothing outside this subpackage imports it.
"""
