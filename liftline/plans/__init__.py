"""Registered queries: an operator bound to the given tables, with its SQL twin."""
