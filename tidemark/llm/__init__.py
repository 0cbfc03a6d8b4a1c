"""Training-data operators: deduplication, filtering, tokenising, archives and extraction.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
