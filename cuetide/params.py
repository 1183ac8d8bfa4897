"""Thresholds of the operators, in one place. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Quality filters of recognised speech.
    compression_limit: float = 8.0
    no_speech_limit: float = 0.6
    log_probability_limit: float = -1.0
    vad_compression_limit: float = 4.0
    vad_no_speech_limit: float = 0.35
    # Repeated runs.
    run_min_count: int = 4
    run_min_chars: int = 6
    run_min_chars_other_scripts: int = 3
    run_min_seconds: float = 6.0
    spread_min_count: int = 2
    spread_min_span: float = 60.0
    spread_high_count: int = 8
    spread_high_span: float = 300.0
    spread_medium_count: int = 5
    spread_medium_span: float = 600.0
    spread_medium_weak: int = 2
    spread_medium_weak_share: float = 0.25
    spread_suspicious: int = 2
    spread_suspicious_share: float = 0.5
    # Low-information runs.
    low_run_count: int = 5
    low_run_span: float = 10.0
    low_single_span: float = 3.0
    phrase_count: int = 4
    phrase_share: float = 0.75
    phrase_min_chars: int = 3
    phrase_span: float = 8.0
    punctuation_run_count: int = 3
    punctuation_run_span: float = 2.0
    # Words.
    low_probability: float = 0.15
    weak_probability: float = 0.2
    short_word: float = 0.133
    long_word: float = 2.0
    anomaly_score: float = 3.0
    word_gap_split: float = 10.0
    word_gap_min_segment: float = 8.0
    coverage_min_chars: int = 10
    coverage_min_ratio: float = 0.35
    # Speech intervals.
    bridge: float = 0.15
    pad: float = 0.4
    silence: float = 1.0
    vad_split_silence: float = 2.0
    owner_slack: float = 0.45
    duplicate_gap: float = 0.2
    duplicate_overlap: float = -0.05
    # Chunks.
    ownership_pad: float = 1.5
    ownership_min_overlap: float = 0.08
    ownership_max_drift: float = 8.0
    upload_seconds: float = 900.0
    context_seconds: float = 2.0
    pack_seconds: float = 30.0
    group_seconds: float = 180.0
    group_count: int = 60
    translation_seconds: float = 900.0
    translation_batch: int = 60
    # Polled tasks: pauses in seconds, and chunks of a medium up to which speakers are told apart.
    poll_first: float = 10.0
    poll_most: float = 30.0
    poll_deadline: float = 7200.0
    speaker_chunks: int = 3
    # Retention.
    candidates_kept: int = 80
    cache_entries: int = 80
    cache_days: int = 30
    cache_bytes: int = 8 * 1024 * 1024
    audio_cache_hours: int = 36
    audio_cache_bytes: int = 2 * 1024 * 1024 * 1024
    candidates_shown: int = 5
    errors_shown: int = 5


P = Params()
