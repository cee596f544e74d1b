"""Operators of a training-data pipeline over document, page and conversation tables.

Nothing outside this package imports it; the queries over the test tables are in ``queries``.
"""
