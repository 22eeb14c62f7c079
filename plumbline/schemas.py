"""Canonical schemas. Every column may be null."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string

THIRD_PARTY = "struct<third_party_etld1: string, entity: string, categories: array<string>, prevalence: double, policy_url: string, tracker_radar_source_domain_file: string, trackerdb_source_pattern_file: string, trackerdb_source_org_file: string, policy_extraction_method: string>"
FETCH = "struct<third_party_etld1: string, policy_url: string, fetch_success: boolean, status_code: int, text_len: int, text_len_raw: int, extraction_method: string, error_message: string>"
FIRST_PARTY = "struct<url: string, status_code: int, likeliness_score: double, text_len: int, text_len_raw: int, extraction_method: string, word_count: int>"

_TABLES = {
    "site_result": f"ingest_seq long, run_id string, input string, site_etld1 string, site_url string, final_url string, rank int, main_category string, status string, non_browsable_reason string, error_code string, error_message string, home_status_code int, home_fetch_mode string, home_fetch_attempts int, home_fetch_ms int, policy_fetch_ms int, third_party_extract_ms int, third_party_policy_fetch_ms int, total_ms int, policy_is_english boolean, first_party_policy {FIRST_PARTY}, first_party_policy_word_count int, third_party_with_english_policy_count int, qualified_site boolean, third_parties array<{THIRD_PARTY}>, third_party_policy_fetches array<{FETCH}>, started_at string, ended_at string",
    "policy_text": "run_id string, site_etld1 string, service_domain string, text string",
    "run_metadata": "out_dir string, run_id string, status string, mode string, total_sites int, started_at string, updated_at string",
    "ranked_list": "rank int, domain string",
    "site_csv": "tranco_id string, domain string, status_code string, crux_code string, categories string, main_category string",
    "page": "url string, html string, text string, status_code int",
    "network_request": "site_url string, url string, event_type string",
    "tracker_entry": "etld1 string, entity string, categories array<string>, prevalence double, policy_url string, source_domain_file string, source_pattern_file string, source_org_file string",
    "policy_cache": "seq long, key string, text string, status_code int, extraction_method string, error_message string, final_url string, alias_of string",
    "outbox_event": "event_id string, run_id string, out_dir string, site string, queued_at string, attempt_count int, last_error string, result_offset long, replay_key string",
    "llm_response": "doc_id string, chunk_index int, response string",
    "annotation_status": "site string, tp string, status string, phase string, model string, reason string, error string, previous_status string, statements int, chunks int, blocks int, tokens_in int, tokens_out int, started_at string, updated_at string, finished_at string",
    "event": "seq long, type string, run_id string, site string, status string, stage string, rank int, processed int, total int, cached boolean, annotated boolean, timestamp string, payload string",
    "eta_sample": "run_id string, processed_sites int, total_sites int, timestamp_ms long",
    "ingestion_log": "ingestion_id string, status string, processed_sites int, error_count int",
    "latency_sample": "op string, seq long, ms double",
}


def schema(name: str) -> StructType:
    return _parse_datatype_string(_TABLES[name])
