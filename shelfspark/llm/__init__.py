"""Operators for large training-data pipelines.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; the registered queries live in :mod:`shelfspark.llm.queries`.
"""
