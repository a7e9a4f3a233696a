"""Operators for large training-data pipelines, and the queries that apply them.

Nothing outside this package imports it.  Every operator takes and returns DataFrames; the
``opN_*`` queries in :mod:`quillmere.llm.queries` are thin projections of those results.
"""
