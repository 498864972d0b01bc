"""All tunable constants in one place.

The corpus contract names these quantities but publishes no values for them, so every
number here is this library's own choice unless the comment says it is contractual.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # contractual
    page_default: int = 25
    page_max: int = 100
    sitemap_page_size: int = 50_000
    signal_window_hours: int = 24
    breaking_max_age_hours: int = 48
    prominence_min_peers: int = 5
    notify_max_bytes: int = 8_000
    soft_quota_share: float = 0.8
    alert_top_ids: int = 5
    words_per_minute: int = 200
    # ours
    stub_words: int = 20
    lag_threshold_hours: int = 12
    cursor_window_hours: int = 24
    sentiment_cut: float = 0.2
    live_hours: int = 72
    engagement_score_weight: float = 1.0
    engagement_reply_weight: float = 2.0
    trend_recent_days: int = 7
    trend_baseline_days: int = 21
    trend_epsilon: float = 0.1
    baseline_days: int = 7
    velocity_ratio: float = 1.2
    velocity_run: int = 2
    volume_z: float = 1.5
    novelty_min_distance: float = 0.5
    divergence_min_spread: float = 0.2
    divergence_min_rows: int = 3
    sentiment_shift_min: float = 0.05
    surge_min_growth: float = 1.0
    register_shift_min: float = 0.05
    phrase_min_delta: float = 0.00005
    phrase_min_count: int = 3
    correlation_min: float = 0.2
    correlation_min_shared: int = 2
    trend_min_slope: float = 0.0
    min_evidence: int = 3
    severity_medium: float = 0.5
    severity_high: float = 0.8
    embedded_share_min: float = 0.05
    thin_min_records: int = 60
    thin_min_kinds: int = 2
    cadence_min_gap_minutes: int = 30
    fingerprint_length: int = 6
    saturation_high: float = 2.0
    saturation_low: float = 1.2
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    ann_lists: int = 100
    trie_names: int = 200_000
    backfill_hours: int = 24


P = Params()
