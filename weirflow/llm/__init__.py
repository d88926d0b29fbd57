"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; ``weirflow.llm.queries`` holds the
queries and the SQL that the driver checks.
"""
