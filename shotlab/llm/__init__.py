"""Operators of a large-scale training-data pipeline, one module per operator.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames with general parameters; ``queries.py`` holds the thin
``opN_<name>`` queries that bind them to the driver tables.
"""
