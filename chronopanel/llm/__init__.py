"""Training-data operators: deduplication, language, extraction, quality, packing, URLs, decontamination, tokens.

Nothing else in the library imports this subpackage.
"""
