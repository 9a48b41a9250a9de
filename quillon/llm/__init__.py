"""Training-data operators: tokenising, redaction, filtering, deduplication, mixing.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
