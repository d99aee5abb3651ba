"""Training-data operators: filtering, deduplication, extraction, scoring and mixing.

Nothing else in the library imports this package.
"""
