"""Operators for preparing training text: sharding, filtering, deduplication, packing, scoring and archives."""
