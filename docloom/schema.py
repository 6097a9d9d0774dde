"""Schemas of the engine's tables and nested values."""

from __future__ import annotations

ENTITY = "struct<text: string, label: string, start: int, end: int, source: string>"
SECTION = "struct<type: string, number: string, title: string, start: int, end: int>"
PAGE_METADATA = "struct<source_file: string, total_pages: int, page_width: double, page_height: double, parser: string, has_tables: boolean, sections: array<string>>"
PAGE = f"struct<page_num: int, text: string, metadata: {PAGE_METADATA}>"
CHUNK = "struct<text: string, section: string, section_num: string, start: int>"
CHUNKS = (
    f"chunk_id string, doc_name string, chunk_index int, total_chunks int, page_num int, section string, section_num string, text string, entities array<{ENTITY}>"
)
QA_ROWS = "question string, answer string, contexts array<string>, reference_answer string, relevant_chunks array<string>, entities array<struct<text: string, label: string>>"
HISTORY = "question string, answer string, timestamp string, confidence double, num_sources int"
NER_ROWS = "text string, entities array<struct<start: int, end: int, label: string>>"
