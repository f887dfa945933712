"""Operators of a training-data pipeline over a ``documents`` table.

Nothing else in the library imports this subpackage. Each module holds one operator
with a general interface; :mod:`ledgerlens.llm.queries` applies each of them to the
whole ``documents`` table as a registered query.
"""
