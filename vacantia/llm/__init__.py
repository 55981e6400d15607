"""Training-data operators: quality, dedup, sharding, media, chat, tokens, mixing, language, LM scores.

Nothing else in the library imports this subpackage.
"""
