"""Operators of a training-data pipeline (deduplication, scoring, packing, tokenising, chat formatting)."""
