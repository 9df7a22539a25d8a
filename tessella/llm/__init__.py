"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Each operator lives in a module
of its own; :mod:`tessella.llm.catalog` lists the queries built from them.
"""
