"""Training-data operators: near-duplicate search, filters, tokenizers, packing.

Nothing outside this subpackage imports it.
"""
