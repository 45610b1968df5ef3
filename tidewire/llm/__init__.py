"""Operations for preparing training data: mixing, deduplication, decontamination,
quality filtering, sharding, secret scans, URL rules and media columns.

Nothing else in the library imports this subpackage.
"""
