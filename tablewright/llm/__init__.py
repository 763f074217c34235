"""Operators for preparing training text: quality, deduplication, tokens, privacy, mixing.

Nothing outside this package imports it. ``tablewright.llm.registry`` holds the queries.
"""
