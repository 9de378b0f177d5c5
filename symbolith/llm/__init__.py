"""Training-data operators: deduplication, extraction, scoring, tokenisation, packing and search.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only when it can be imported.
"""
