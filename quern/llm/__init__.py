"""Training-data operators.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it, so the
folder can be removed without touching the rest of the library.
"""
