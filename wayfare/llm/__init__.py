"""Operators of a large-scale training-data pipeline.

Every module holds one operator with a general interface; ``queries`` binds them
to the standard tables. Nothing outside this package imports it.
"""
