"""Operators for preparing training text: deduplication, fingerprints, privacy, quality, mixing, scoring, encoding.

Nothing outside this package imports it. ``plumbline.llm.catalogue`` holds the registered queries.
"""
