"""Kinds, legal combinations, schemas and tuning defaults of the annotation archive."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTENT_KINDS = ("remark", "rating", "stroke")
META_KINDS = ("revision", "retraction", "redaction")
#: What each kind of meta event may point at.
LEGAL_TARGETS = {
    "revision": ("remark", "revision"),
    "retraction": ("remark", "rating", "stroke", "revision"),
    "redaction": ("remark", "revision", "stroke"),
}
#: Which sources may produce which kind.
LEGAL_SOURCES = {
    "remark": ("typed", "voice"),
    "rating": ("typed", "voice"),
    "stroke": ("pencil",),
    "revision": ("typed", "voice"),
    "retraction": ("system", "typed", "voice"),
    "redaction": ("system", "typed"),
}
JOURNAL = "id long, ts timestamp, session long, kind string, source string, target_event long, image long, text string, rating int, scrubbed boolean"


@dataclass(frozen=True)
class Tuning:
    """Defaults; a value outside its range falls back to the default in ``checked``."""

    text_limit: int = 500
    vector_limit: int = 200
    browse_limit: int = 500
    result_limit: int = 100
    rrf_k: int = 60
    beta: float = 0.5
    weights: tuple[float, ...] = (1.0, 1.0, 0.5, 0.5, 1.0)
    hamming: int = 8
    alpha: float = 0.5
    kmeans_low: int = 2
    kmeans_high: int = 12
    kmeans_rounds: int = 50
    lod_limit: int = 1500
    cutoff_high: float = 1.0
    cutoff_low: float = 0.55
    lambda_floor: float = 0.3
    neighbours: int = 12
    dwell_weight: float = 0.0001
    events_weight: float = 1.0
    strokes_weight: float = 0.5
    half_life_days: float = 14.0
    dwell_look_rate: float = 1.0
    dwell_grid_rate: float = 0.15
    dwell_cap_ms: int = 60000
    vad_enter: float = 0.5
    vad_exit: float = 0.35
    vad_hang: int = 15
    session_gap_seconds: int = 1800
    burst_size: int = 4
    link_gap_seconds: int = 10
    name_threshold: float = 0.80

    def checked(self, **changes: float) -> Tuning:
        ok = {k: v for k, v in changes.items() if hasattr(self, k) and (isinstance(v, tuple) or v >= 0)}
        return replace(self, **ok)


TUNING = Tuning()


def valid_event() -> Column:
    """The data-quality predicate of a journal row."""
    source_ok = F.lit(False)
    for kind, sources in LEGAL_SOURCES.items():
        source_ok = source_ok | ((F.col("kind") == kind) & F.col("source").isin(*sources))
    shape = (
        F.when(F.col("kind").isin(*META_KINDS), F.col("image").isNull())
        .when(F.col("kind") == "rating", F.col("rating").between(0, 5))
        .otherwise(F.col("target_event").isNull())
    )
    return F.coalesce(F.col("id").isNotNull() & F.col("ts").isNotNull() & source_ok & shape, F.lit(False))
