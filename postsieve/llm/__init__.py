"""Training-data operators: deduplication, language identification, packing and scans.

Nothing outside this package (but ``corpus_pipeline.py`` and the guard in
``__spark_entry__.py``) imports it.
"""
