"""Analytical operators: each takes and returns DataFrames."""
