"""Operators for preparing training text: counting, tokenising, searching, deduplicating, scoring.

Nothing outside this subpackage imports it.
"""
