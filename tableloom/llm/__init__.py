"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; the queries it offers are listed
in :mod:`tableloom.llm.queries`.
"""
