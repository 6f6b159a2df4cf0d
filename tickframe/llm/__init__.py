"""Training-data operators: deduplication, tokenisation, formatting, language ID and mixing.

Nothing outside this package imports it.
"""
