"""Operators for training-data pipelines.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so it
can be removed without affecting the rest of the library.
"""
