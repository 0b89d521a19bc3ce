"""Training-data operators (near-dedup, decontamination, language, tokens, quality, PII, ...).

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` in
``quillforge.llm.registry`` are what the driver's entry module picks up when the folder is present.
"""
