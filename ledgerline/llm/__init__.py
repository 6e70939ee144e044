"""Operators for building training data from text corpora (see README).

Nothing outside this folder (but ``corpus_pipeline.py``) imports it.
"""
