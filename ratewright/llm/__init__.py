"""Operators for preparing training text: filtering, deduplication, formatting, mixing, search.

Nothing else in the library imports this subpackage.
"""
