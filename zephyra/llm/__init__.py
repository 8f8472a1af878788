"""Operators for training data: language, search, shards, tokens, archives, contamination, toxicity and copies."""
