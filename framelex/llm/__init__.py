"""Operators of a training-data pipeline.

Each module holds one operator with its own general interface; the queries
that apply them to the given tables are in :mod:`registry`. Nothing outside
this subpackage imports it.
"""
