"""Operators for preparing text corpora: identification, deduplication, mixing, search and encoding."""
