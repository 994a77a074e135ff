"""Training-data operators: mixing, deduplication, scoring, formatting, counting, sharding, screening.

Nothing else in the library imports this subpackage.
"""
