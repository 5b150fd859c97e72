"""Operators for building training data: one module per operator.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; ``queries`` holds the registered queries and their SQL.
"""
