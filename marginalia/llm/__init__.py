"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each operator has a
general interface in its own module; `queries` holds the thin queries that
apply the operators to whole tables.
"""
