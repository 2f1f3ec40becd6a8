"""Operators for preparing training data: one module for each operator.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
(:mod:`gradloom.llm.queries`) when the folder is there.
"""
