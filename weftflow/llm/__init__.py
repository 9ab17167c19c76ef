"""Operators for training-data pipelines: tokens, decontamination, duplicates, filters and scans.

Nothing outside this subpackage imports it; :mod:`weftflow.llm.queries` registers its queries.
"""
