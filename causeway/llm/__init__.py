"""Operators for preparing large text corpora: dedup, scoring, packing, tokens, search, filters."""
