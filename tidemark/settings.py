"""Settings of the behaviour-log engine (S15, T1): one frozen dataclass instead of files and caches."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from datetime import date, datetime, timedelta, timezone
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    # Behaviours and their ids, sentinels, evaluation cutoffs.
    behaviors: dict[str, int] = field(default_factory=lambda: {"view": 0, "cart": 1, "purchase": 2})
    target: str = "purchase"
    unknown_brand: str = "__UNKNOWN_BRAND__"
    unknown_category: str = "__UNKNOWN_CATEGORY__"
    unknown_session: str = "__UNKNOWN_SESSION__"
    ks: tuple[int, ...] = (1, 5, 10, 20, 50)
    category_level: str = "top"
    train_end: str = "1998-12-31"
    val_end: str = "1999-12-31"
    min_user: int = 5
    min_item: int = 5
    rounds: int = 3
    transductive: bool = False
    drop_repeated: bool = True
    metadata_source: str = "train_only"
    seed: str = "42"

    def __post_init__(self) -> None:
        if self.train_cut >= self.val_cut:
            raise ValueError("train_end must come before val_end")
        if self.target not in self.behaviors:
            raise ValueError(f"unknown target behaviour {self.target}")

    @property
    def train_cut(self) -> int:
        return cutoff(self.train_end)

    @property
    def val_cut(self) -> int:
        return cutoff(self.val_end)

    @classmethod
    def load(cls, path: str) -> Settings:
        """From a JSON file; other keys are errors."""
        values = json.loads(Path(path).read_text())
        known = {f.name for f in fields(cls)}
        if extra := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(extra)}")
        return cls(**{k: tuple(v) if k == "ks" else v for k, v in values.items()})


def cutoff(day: str) -> int:
    """Epoch seconds of midnight UTC after the named day: windows are half-open."""
    after = date.fromisoformat(day) + timedelta(days=1)
    return int(datetime(after.year, after.month, after.day, tzinfo=timezone.utc).timestamp())
