"""Operators for preparing training text, their registered queries and oracles.

Nothing outside this subpackage imports it, except `__spark_entry__.py` (guarded) and `corpus_pipeline.py`.
"""
