"""Operators for preparing text and media corpora for model training.

Nothing outside this subpackage imports it.
"""
