"""Parameters of the operators with their default values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Decay:
    """Temporal weighting of library items."""

    halflife_days: float = 180.0
    min_weight: float = 0.05


@dataclass(frozen=True)
class Fusion:
    """Blend of neighbour, cluster and journal scores."""

    neighbors: int = 5
    micro_weight: float = 0.65
    similarity_weight: float = 0.8
    journal_weight: float = 0.2

    def __post_init__(self) -> None:
        if abs(self.similarity_weight + self.journal_weight - 1.0) > 1e-6:
            raise ValueError("similarity_weight and journal_weight must sum to 1")


@dataclass(frozen=True)
class JournalScores:
    """Scores of works without a usable impact factor, and the log base for the others."""

    arxiv: float = 0.6
    cn_core: float = 0.7
    unknown: float = 0.3
    log_base: float = 25.0


@dataclass(frozen=True)
class Thresholds:
    """Label thresholds: fixed values, or percentiles with floors."""

    mode: str = "dynamic"
    must_read: float = 0.65
    consider: float = 0.45
    must_read_percentile: float = 95.0
    consider_percentile: float = 70.0
    min_must_read: float = 0.60
    min_consider: float = 0.40


@dataclass(frozen=True)
class WatchLimits:
    """What is cut from the ranked list."""

    recent_days: int = 7
    max_preprint_ratio: float = 0.9
    top_k: int = 20
    require_abstract: bool = True


@dataclass(frozen=True)
class Interests:
    """Interest selection sizes."""

    max_documents: int = 500
    top_k: int = 5


@dataclass(frozen=True)
class Clustering:
    """Profile clustering."""

    min_clusters: int = 5
    max_clusters: int = 35
    min_cluster_size: int = 1
    tolerance: float = 0.20
    iterations: int = 20
    search_iterations: int = 10
    titles_per_cluster: int = 5
    keywords_per_cluster: int = 10
    recent_age_days: float = 90.0
    seed: int = 42


@dataclass(frozen=True)
class LibraryStats:
    """Library analytics sizes."""

    keywords: int = 50
    authors: int = 30
    venues: int = 20
    years_back: int = 3
    recent_days: int = 30
    year_window: int = 20
    author_min_count: int = 10


@dataclass(frozen=True)
class WatchSettings:
    """Everything a full run needs."""

    decay: Decay = field(default_factory=Decay)
    fusion: Fusion = field(default_factory=Fusion)
    journal: JournalScores = field(default_factory=JournalScores)
    thresholds: Thresholds = field(default_factory=Thresholds)
    limits: WatchLimits = field(default_factory=WatchLimits)
    interests: Interests = field(default_factory=Interests)
    title_threshold: float = 0.9
    candidate_ttl_days: int = 7
