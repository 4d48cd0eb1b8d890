"""Operators of a training-data pipeline over the ``documents``, ``pages`` and ``conversations`` tables.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
