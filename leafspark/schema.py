"""The canonical chunk schemas, as DDL."""

from __future__ import annotations

ELEMENT_TYPES = ("title", "header", "narrative_text", "list_item", "code_snippet", "procedure_step")
CHUNKS = (
    "doc_id BIGINT, chunk_id STRING, content STRING, h1 STRING, h2 STRING, h3 STRING, h4 STRING, h5 STRING, h6 STRING, original_position INT, sub_index INT, token_count INT, "
    "parent_id STRING, depth_level INT, sequence_number BIGINT, is_inside_code_block BOOLEAN, element_type STRING, embedding ARRAY<FLOAT>, norm DOUBLE"
)
JSON_CHUNK = ("chunk_id STRING, content STRING, metadata STRUCT<h1: STRING, h2: STRING, h3: STRING, h4: STRING, h5: STRING, h6: STRING, original_position: INT, token_count: INT, parent_id: STRING, depth_level: INT, sequence_number: BIGINT, is_inside_code_block: BOOLEAN, element_type: STRING>, embedding ARRAY<FLOAT>")
