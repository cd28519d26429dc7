"""Operators of a training-data pipeline: deduplication, packing, scoring, archives, search, language, tokens, personal data.

Nothing else in the library imports this package.
"""
