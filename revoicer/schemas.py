"""Schemas of the records that stages exchange. Every table is keyed by ``m``, the media."""

from __future__ import annotations

SILENCE = "m bigint, start_s double, end_s double"
CHUNK = "m bigint, idx int, start_s double, end_s double, cut_source string"
SPAN = "m bigint, idx int, start_s double, end_s double, text string"
SEGMENT = "m bigint, id int, start double, end double, text string, speaker string, chunk_index int, boundary_source string, origin array<int>"
SEGMENT_JSON = "id int, start double, end double, text string, speaker string, translation string"
ATTEMPT = "m bigint, segment_id int, attempt int, pace double, duration_s double, trimmed boolean, request_id string, cache_hit boolean"
FIT = "m bigint, segment_id int, target double, achieved double, baseline double, final_pace double, attempts int, clamped boolean, converged boolean"
API_CALL = "stage string, endpoint string, model string, cache_hit boolean, latency_s double, cost_inr double, cost_if_billed_inr double, billable_units double, billable_unit_name string, http_status int, attempts int, request_id string"
PLACEMENT = "m bigint, segment_id int, window_start_s double, window_end_s double, placed_start_s double, duration_s double, lead_trim_s double, source_path string, fitted boolean, fade_frames bigint, clipped_samples bigint, overlapped_frames bigint, truncated_frames bigint"
SCORE = "m bigint, segment_id int, wer double, cer double, abs_drift_pct double, overlap_s double, combined double, reasons array<string>"
MEDIA = "m bigint, path string, duration_s double, rate int, channels int, codec string"
WAV_INFO = "channels int, sample_width int, frame_rate int, frames bigint, duration_s double"
CACHE = "key string, stage string, model string, params map<string,string>, input_hash string, payload string, has_binary boolean, binary binary"
