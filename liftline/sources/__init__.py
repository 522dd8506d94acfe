"""Readers and writers for result tables, trade logs and price files."""
