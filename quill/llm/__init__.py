"""Operators for preparing training data: ten dealt operators and their queries.

Nothing else in the library imports this subpackage.
"""
