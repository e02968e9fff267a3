"""Operators for preparing training data: filtering, near-duplicate search, sharding, scoring and encoding of documents."""
