"""Settings that define results, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    #: The moment that ages are counted to; a parameter, so that results can be repeated.
    as_of: str = "2026-07-01 00:00:00"
    min_words: int = 4
    weight_max: float = 5.0
    min_alpha: int = 8
    max_symbol_ratio: float = 0.40
    min_diversity: float = 0.42
    toxicity_policy: str = "keep_flag"
    profanity_only_words: int = 6
    flagged_multiplier: float = 0.85
    borderline_min: float = 0.35
    borderline_max: float = 0.55
    #: Borderline rows of one video that are reviewed.
    max_reviews: int = 300
    topic_overlap: int = 1
    #: Comments of one video at most, and of its sample by relevance (14 pages of 100).
    max_comments: int = 1500
    max_relevant: int = 1400
    # clusters
    cluster_min_size: int = 6
    cluster_min_samples: int = 2
    cluster_max: int = 10
    soft_assign: float = 0.50
    ambiguous_confidence: float = 0.65
    ambiguous_margin: float = 0.12
    low_confidence: float = 0.35
    low_cosine: float = 0.25
    coherence_min: float = 0.45
    emerging_coherence: float = 0.70
    ambiguous_share: float = 0.45
    large_share_pct: float = 25.0
    merge_cosine: float = 0.88
    merge_jaccard: float = 0.20
    trend_score: float = 0.60
    position_cosine: float = 0.34
    position_margin: float = 0.035
    # topics of a run
    low_coherence_share: float = 8.0
    uncertain_min_comments: int = 1
    uncertain_support: float = 0.14
    topic_merge_cosine: float = 0.88
    topic_merge_jaccard: float = 0.24
    topic_subset_tokens: int = 2
    note_limit: int = 3
    #: Shares, in per cent, beyond which a run counts as degraded.
    watchdog_undetermined: float = 35.0
    watchdog_fallback: float = 40.0
    # appeal
    auto_ban_review: float = 0.80
    precision: float = 0.85


DEFAULT = Settings()
