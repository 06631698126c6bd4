"""Training-data operators: scoring, privacy, tokenization, deduplication and chat formatting.

Nothing outside this subpackage imports it.
"""
