"""Training-data operators: tokens, packing, quality, language, dedup, search and media.

Nothing outside this subpackage imports it.
"""
