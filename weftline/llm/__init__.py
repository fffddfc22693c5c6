"""Operations on training text: scoring, deduplication, filtering, archives, search, mixing and tokens.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
