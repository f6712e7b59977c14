"""Operators for preparing training data: one module per operator.

Nothing else in the library imports this subpackage. ``queries.py`` applies
each operator to its table; ``common.py`` holds the few shared helpers.
"""
