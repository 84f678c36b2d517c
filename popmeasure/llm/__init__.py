"""Operators that prepare training text: language, digests, repeats, quality, tokens, mixing, secrets, pseudonyms, shards, near copies."""
