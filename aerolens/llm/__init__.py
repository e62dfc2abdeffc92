"""Operators for large text corpora: deduplication, archives, packing, scans,
mixing, search, chat formatting, sharding and quality rules.

Nothing else in the library imports this subpackage; its queries and their
SQL are in ``aerolens.llm.queries``.
"""
