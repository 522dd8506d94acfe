"""Structured Streaming forms of the algebraic aggregates."""
