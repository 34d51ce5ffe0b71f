"""Roles of the canonical post table, capabilities derived from them, thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

# Role name -> canonical column name.
CANONICAL_NAMES = {
    "id_col": "id",
    "text_col": "text",
    "timestamp_col": "ts",
    "author_col": "author",
    "engagement_col": "engagement",
    "platform_col": "platform",
}

# Optional canonical column -> capability it enables.
CAPABILITY_OF = {
    "ts": "temporal",
    "author": "author_profile",
    "engagement": "amplification",
    "platform": "cross_platform",
}


@dataclass(frozen=True)
class DatasetRoles:
    """Which raw column plays which role; only id, text and language are required."""

    id_col: str
    text_col: str
    language: str
    timestamp_col: str | None = None
    author_col: str | None = None
    engagement_col: str | None = None
    platform_col: str | None = None
    extra_dims: dict[str, str] = field(default_factory=dict)

    def renames(self) -> dict[str, str]:
        pairs = ((getattr(self, role), name) for role, name in CANONICAL_NAMES.items())
        return {raw: name for raw, name in pairs if raw}


@dataclass(frozen=True)
class Thresholds:
    bot_quarantine_pct: float = 10.0
    outlier_rerun_pct: float = 25.0
    burst_sigma: float = 3.0
    duplication_alarm_pct: float = 20.0
    min_topic_size: int = 15


def capabilities(columns) -> set[str]:
    """What can be analysed, from the canonical columns that are present."""
    return {"text", "id"} | {cap for col, cap in CAPABILITY_OF.items() if col in columns}
