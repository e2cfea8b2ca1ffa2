"""Operators that prepare text for training language models.

Nothing outside this folder (but for ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py``) imports it.
"""
