"""Operators of a training-data pipeline: packing, scoring, deduplication, filtering and sharding.

Nothing else in the library imports this subpackage; ``nightledger.llm.queries``
lists its registered queries.
"""
