"""Operators for large training-text corpora.

Nothing outside this subpackage imports it.  Every module states its contract
(nulls, empty tables, ties, extra columns) in its docstring.
"""
