"""Explicit schemas of the engine's records, as DDL; nothing in the engine infers one."""

from __future__ import annotations

PAPERS = (
    "id BIGINT, arxiv_id STRING, openalex_id STRING, title STRING, authors ARRAY<STRING>, year INT, cited_by_count INT, abstract STRING, source_format STRING, "
    "raw_path STRING, extracted_text_path STRING, fetched_at TIMESTAMP, created_at TIMESTAMP, text_title_match FLOAT"
)
WORKS = (
    "id STRING, display_name STRING, publication_year INT, cited_by_count INT, doi STRING, referenced_works ARRAY<STRING>, "
    "locations ARRAY<STRUCT<landing_page_url: STRING, pdf_url: STRING>>, abstract_inverted_index MAP<STRING, ARRAY<INT>>"
)
CORPUS = ("arxiv_id STRING, openalex_id STRING, title STRING, year INT, cited_by_count INT, in_corpus_refs INT, seed_relevance DOUBLE, seed BOOLEAN")
DEFINITIONS = (
    "id BIGINT, paper_id BIGINT, concept STRING, prompt_version STRING, defines_concept BOOLEAN, definition STRING, verbatim_quote STRING, quote_verified BOOLEAN, "
    "section STRING, novelty_claims ARRAY<STRING>, embedding ARRAY<FLOAT>, model STRING"
)
NODE = "STRUCT<node_id: STRING, label: STRING, year_start: INT, year_end: INT, definition_ids: ARRAY<BIGINT>, representative_arxiv_id: STRING, members: ARRAY<STRUCT<arxiv_id: STRING, year: INT, title: STRING>>>"
EDIT = "STRUCT<op: STRING, detail: STRING, at: TIMESTAMP, by: STRING>"
GENEALOGIES = (f"id BIGINT, concept STRING, prompt_version STRING, status STRING, spend_usd DECIMAL(8,4), nodes ARRAY<{NODE}>, user_edits ARRAY<{EDIT}>, created_at TIMESTAMP, updated_at TIMESTAMP")
EDGES = (
    "id BIGINT, genealogy_id BIGINT, source_node STRING, target_node STRING, edge_type STRING, source_paper_id BIGINT, target_paper_id BIGINT, source_quote STRING, "
    "target_quote STRING, confidence FLOAT, verified BOOLEAN, rationale STRING, citation_context STRING"
)
REQUESTS = (
    "id BIGINT, concept STRING, corpus_limit INT, requested_by STRING, note STRING, status STRING, decided_by STRING, decided_at TIMESTAMP, started_at TIMESTAMP, finished_at TIMESTAMP, "
    "progress STRUCT<stage: STRING, stage_no: INT, stages: INT, message: STRING, current: INT, total: INT, spend_usd: DOUBLE>, error STRING, genealogy_id BIGINT, field_id STRING, gloss STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
EXPORTED_EDGE = "STRUCT<source_node: STRING, target_node: STRING, edge_type: STRING, confidence: DOUBLE, verified: BOOLEAN, source_paper: STRING, target_paper: STRING, source_quote: STRING, target_quote: STRING>"
EXPORT = (f"concept STRING, prompt_version STRING, nodes ARRAY<{NODE}>, edges ARRAY<{EXPORTED_EDGE}>, stats STRUCT<nodes: BIGINT, edges: BIGINT, verified_edges: BIGINT, inferred_edges: BIGINT>")

#: What the status and type columns may hold.
REQUEST_STATUS = ("requested", "approved", "rejected", "running", "complete", "failed")
GENEALOGY_STATUS = ("pending", "running", "complete", "failed", "aborted_spend_cap")
SOURCE_FORMATS = ("latex", "pdf")
