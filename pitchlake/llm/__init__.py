"""Training-data operators: tokenising, scoring, scanning, deduplication, search.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
