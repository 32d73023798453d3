"""Operators of a training-data pipeline: language ID, reputation, chat packing, deduplication, tokens, search and secrets."""
