"""Operators: global and per-group ranking, load gates, data-quality checks."""
