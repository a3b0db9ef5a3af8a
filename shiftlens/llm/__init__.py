"""Operators for preparing training text: filters, classifiers, duplicate removal, tokenising, scoring.

Nothing outside this sub-package imports it. Every operator takes and returns DataFrames; the thin
registered queries are in ``queries`` and the DuckDB statements in ``oracles``.
"""
