"""Training-data operators: language, quality, duplicates, mixing, packing, search, licences and chat text.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
