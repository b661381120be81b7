"""Schemas that are checked where tables enter and leave."""

from __future__ import annotations

BLOCKS = "document_id string, block_no bigint, type string, text string, heading_path array<string>, header array<string>"
CHUNKS = (
    "chunk_id string, document_id string, document_name string, publisher string, year int, source_url string, "
    "retrieval_date string, section_heading string, block_type string, text string, embed_text string"
)
MANIFEST = (
    "document_id string, document_name string, publisher string, year int, source_url string, downloaded_url string, retrieval_date string, "
    "sha256 string, http_status int, content_type string, status string, file string, error string"
)
DRAFTS = "query_id bigint, document_pos int, document_id string, claim_no int, text string, chunk_ids array<string>"
HITS = (
    "query_id bigint, rank int, chunk_id string, similarity double, document_id string, document_name string, publisher string, year int, "
    "source_url string, section_heading string, block_type string, retrieval_date string, text string"
)
QUESTIONS = "query_id bigint, message string, document_id string"
# Domains.
BLOCK_TYPES = ("heading", "paragraph", "list_item", "table")
CHUNK_TYPES = ("paragraph", "list_item", "table_row")
METADATA = ("document_id", "document_name", "publisher", "year", "source_url", "retrieval_date", "section_heading", "block_type")
