"""Operators for training-data pipelines: text, pages, tokens and media columns.

Nothing else in the library imports this subpackage.
"""
