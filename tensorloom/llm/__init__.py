"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
of :mod:`tensorloom.llm.registry` are what the entry module adds.
"""
