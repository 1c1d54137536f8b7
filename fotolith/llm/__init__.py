"""Operators of a training-data pipeline over the tables documents, pages, benchmark, labels and conversations.

Nothing outside this subpackage imports it; `queries.py` registers one query for each operator.
"""
