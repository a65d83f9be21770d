"""Training-data operators: scoring, language ID, packing, chat, rollups, dedup, BPE, PII.

Nothing outside this package imports it; ``calibra.llm.queries`` holds the
registered queries and ``corpus_pipeline.py`` at the repository top the pipeline.
"""
