"""Operators of a training-data pipeline over documents and conversations.

Nothing outside this subpackage imports it; the queries built on these
operators are in `queries.py`, their SQL in `oracles.py`.
"""
