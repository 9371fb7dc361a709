"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; :mod:`veilspan.llm.queries` derives the fixed-result queries from them.
"""
