"""Operators of a large-scale training-data pipeline, each a Spark job.

Nothing outside this subpackage imports it.  Queries over the numbered
operators are in :mod:`lumiframe.llm.queries`.
"""
