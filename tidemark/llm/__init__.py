"""Operators for training-data pipelines, each built by one named method.

Nothing outside this package imports it; ``tidemark.llm.queries`` binds the operators to the
test tables and holds the SQL they are compared with.
"""
