"""Training-data operators: sharding, deduplication, tokens, mixing, language and quality.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
