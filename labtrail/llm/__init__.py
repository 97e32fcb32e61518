"""Training-data operators: search, near and exact dedup, tokens, language, chat, packing, personal data, mixing.

Nothing else in the package imports this folder.
"""
