"""Training-data operators: quality, dedup, language, archives, token files, decontamination, sharding, secrets.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
