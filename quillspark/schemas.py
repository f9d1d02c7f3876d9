"""Schemas of the engine's tables, as Spark DDL."""

from __future__ import annotations

ISSUES = "array<struct<span:string,type:string,severity:string,reason:string>>"
SCHEMAS = {
    "archive_entries": "archive string, ordinal int, name string, compressed bigint, expanded bigint, method int, encrypted boolean",
    "segments": "doc_id string, block int, seg_pos int, seg_id string, text string, source_hash string, leading string, trailing string, format string",
    "batches": "batch_id string, segs array<struct<id:string,text:string>>",
    "pairs": "doc_id string, seg_pos int, seg_id string, source string, target string",
    "defects": "seg_id string, kind string, detail string, spans array<string>",
    "findings": f"batch_id string, seg_id string, issues {ISSUES}, rejected_issues int, audit_error string",
    "glossary": "ordinal int, id string, source string, target string, category string, note string, enabled boolean",
    "usage": "append_seq bigint, recorded_at timestamp, call_id string, run_id string, stage string, operation string, profile string, endpoint string, model string, outcome string, prompt_tokens bigint, cached_prompt_tokens bigint, completion_tokens bigint, total_tokens bigint",
    "journal": "append_seq bigint, stage string, batch_id string, checkpoint_key string, segments array<struct<id:string,text:string>>, attempts int, warnings array<string>, profile string, model string",
    "events": "id bigint, job_id string, type string, timestamp timestamp, message string, data string",
    "jobs": "id string, title string, source_language string, target_language string, status string, stage string, progress struct<translated:int,edited:int,total:int,failed:int>, created_at string, updated_at string, warnings int",
    "ledger": "append_seq bigint, event string, reservation_id string, delegation_id string, amount double, cost double, currency string",
    "eval_cases": "id string, draft string, edited string, forbidden array<string>, required_any array<string>",
}
