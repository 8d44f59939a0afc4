"""Schemas of the document model and of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCKS = f"document_id string, page_number int, block_id string, type string, text string, reading_order int, bbox {BOX}, confidence double, parent_id string, provider_block_id string, attributes map<string,string>"
PROVIDER_BLOCKS = "document_id string, page_number int, width double, height double, rotation int, position int, provider_block_id string, provider_type string, text string, bbox array<double>, confidence double, order_hint int, cells array<array<string>>, caption string"
PAGES = "document_id string, page_number int, width double, height double, rotation int"
HIERARCHY = "document_id string, node_seq int, node_id string, kind string, label string, text string, parent_id string, source_block_ids array<string>, ordinal int"
TABLES = "document_id string, table_id string, page_number int, block_id string, n_rows int, n_cols int, cells array<array<string>>, caption string"
FIELDS = "document_id string, field_id string, name string, raw_value string, normalized_value string, value_type string, confidence double, review_status string, source_block_ids array<string>, source_page_numbers array<int>"
DOCUMENTS = "id string, filename string, content_type string, byte_size int, checksum_sha256 string, storage_uri string, status string, document_type string, document_number string, title string, issuer string, issued_date date, signer string, deadline date, current_parse_run_id string, requires_user_review boolean, error_code string, error_message string, created_at timestamp, updated_at timestamp"
JOBS = "id string, document_id string, kind string, status string, attempt int, max_attempts int, idempotency_key string, leased_by string, lease_expires_at timestamp, available_at timestamp, error string, created_at timestamp, updated_at timestamp"
PARSE_RUNS = "id string, document_id string, job_id string, version int, is_current boolean, parser_name string, parser_version string, configuration_hash string, strategy_decided boolean, degraded boolean, route string, schema_version string, canonical string, inspection string, quality_report string, started_at timestamp, finished_at timestamp, created_at timestamp"
FEEDBACK = "id string, document_id string, feedback_type string, field_id string, corrected_value string, comment string, created_at timestamp"
TRUTH = "document_id string, page_count int, critical_fields map<string,string>, reading_order array<string>, headings array<struct<level:int,text:string>>, lists array<array<string>>, tables array<struct<page_number:int,cells:array<array<string>>>>, header_footer_texts array<string>, transcript map<string,string>"
MANIFEST = "document_id string, path string, route_label string, difficulty string, provenance string, ground_truth string, notes string"
SCHEMA_VERSION = "1.0"

#: Error codes that a retry may cure (fixed values).
RETRYABLE = ("parse_timeout", "provider_failure")


def error_record(code: Column, message: Column, parser: Column | None = None, retryable: Column | None = None, details: Column | None = None) -> Column:
    """``struct<code, message, retryable, parser_name, details>``; retryable follows from the code unless given. Null code: null."""
    own = code.isin(*RETRYABLE) if retryable is None else F.coalesce(retryable, code.isin(*RETRYABLE))
    name = F.lit(None).cast("string") if parser is None else parser
    more = F.lit(None).cast("map<string,string>") if details is None else details
    return F.when(code.isNotNull(), F.struct(code.alias("code"), message.alias("message"), own.alias("retryable"), name.alias("parser_name"), more.alias("details")))
