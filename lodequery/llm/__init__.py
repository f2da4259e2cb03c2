"""Training-data operators: tokens, language, near-duplicates, sharding, packing, formatting, toxicity and top-k search.

Nothing outside this subpackage imports it.
"""
