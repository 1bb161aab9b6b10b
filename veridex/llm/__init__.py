"""Training-data operators: deduplication, filters, tokenizing, search and sharding.

Nothing else in the library imports this subpackage.
"""
