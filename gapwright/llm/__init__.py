"""Training-data operators: PII, quality, near-duplicates, packing, decontamination, token shards.

Nothing outside this subpackage imports it.
"""
