"""Training-data operators: search, scoring, archives, tokens and deduplication.

Nothing else in the library imports this subpackage.
"""
