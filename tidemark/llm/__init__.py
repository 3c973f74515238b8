"""Training-data operators: tokens, packing, filters, deduplication, encodings.

Nothing outside this package (and corpus_pipeline.py) imports it.
"""
