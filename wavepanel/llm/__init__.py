"""Operators of a training-data pipeline over text tables.

One module per operator; ``queries`` holds the thin registered queries and
their DuckDB SQL.  Nothing outside this subpackage imports it.
"""
