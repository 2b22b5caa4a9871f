"""Settings as frozen values that are passed in; there is no global state."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

CRITERIA = ("resolution", "size", "date", "filename")
# Hash side per scan mode.
HASH_SIDE = {"normal": 8, "medium": 10, "advanced": 12, "ultra": 16}


@dataclass(frozen=True)
class Filters:
    """Scan filters; 0 turns a size limit off."""

    # Limits and patterns that apply where nothing is set.
    min_size_bytes: int = 1024
    max_size_mb: int = 500
    include_hidden: bool = False
    include_system: bool = False
    excluded_patterns: tuple[str, ...] = ("*.tmp", "*.temp", "*_backup*", "*.bak")
    own_output: tuple[str, ...] = ()

    @property
    def recovery(self) -> bool:
        """Everything that can be lifted is lifted."""
        return self.max_size_mb == 0 and self.include_hidden and not self.excluded_patterns


DEFAULT_FILTERS = Filters()
RECOVERY_FILTERS = Filters(max_size_mb=0, include_hidden=True, excluded_patterns=())
LIFTABLE = ("too_large", "excluded_pattern", "hidden")


@dataclass(frozen=True)
class Priorities:
    """``order`` ranks the criteria (1 is first), ``enabled`` drops one."""

    # Rank of each criterion, and the gap that lets a date decide.
    order: tuple[int, int, int, int] = (2, 3, 1, 4)
    enabled: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(CRITERIA, True))
    oldest: bool = True
    gate_gap_hours: float = 24.0

    @property
    def weights(self) -> dict[str, int]:
        order = self.order if sorted(self.order) == [1, 2, 3, 4] else (2, 3, 1, 4)
        return {c: 5 - r for c, r in zip(CRITERIA, order, strict=True)}

    @property
    def gate_gap_seconds(self) -> float:
        return max(0.0, self.gate_gap_hours) * 3600.0


@dataclass(frozen=True)
class Safety:
    """What an action asks for before it moves anything; ``max_files`` 0 means
    any number."""

    dry_run: bool = True
    confirm: bool = True
    max_files: int = 0


def scaled_threshold(base: int, side: int) -> int:
    """Hamming threshold for a hash of ``side`` squared bits, in proportion to
    64 bits, half to even."""
    base = max(1, int(base) or 5)
    return base if side == 8 else max(1, round(base * side * side / 64))


# The names under which a settings file holds what follows.


def _number(value: Any, default: float) -> float:
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else default


def _part(path: str, name: str) -> dict:
    """One part of a JSON settings file, empty if it cannot be read."""
    try:
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
    except (OSError, ValueError):
        return {}
    part = settings.get(name) if isinstance(settings, dict) else None
    return part if isinstance(part, dict) else {}


def load_safety(path: str) -> Safety:
    """Safety settings of a JSON settings file; a limit that is no number is
    none."""
    s, base = _part(path, "safety"), Safety()
    try:
        most = int(s.get("max_files_per_operation", base.max_files))
    except (TypeError, ValueError):
        most = 0
    return Safety(bool(s.get("dry_run_mode", base.dry_run)), bool(s.get("confirm_before_delete", base.confirm)), max(0, most))


def load(path: str) -> tuple[Filters, Priorities]:
    """Filters and priorities of a JSON settings file. What is missing or of
    another kind has its default; so has all of it if the file is unreadable."""
    f, p, base, first = _part(path, "filters"), _part(path, "priorities"), DEFAULT_FILTERS, Priorities()
    patterns, order, enabled = f.get("exclude_patterns"), p.get("order"), p.get("enabled")
    filters = Filters(
        min_size_bytes=int(_number(f.get("min_file_size_bytes"), base.min_size_bytes)),
        max_size_mb=int(_number(f.get("max_file_size_mb"), base.max_size_mb)),
        include_hidden=bool(f.get("include_hidden", base.include_hidden)),
        include_system=bool(f.get("include_system", base.include_system)),
        excluded_patterns=tuple(map(str, patterns)) if isinstance(patterns, list) else base.excluded_patterns,
    )
    valid = isinstance(order, list) and sorted(map(str, order)) == ["1", "2", "3", "4"] and all(isinstance(x, int) for x in order)
    return filters, Priorities(
        order=tuple(order) if valid else first.order,
        enabled={c: bool(enabled.get(c, True)) for c in CRITERIA} if isinstance(enabled, dict) else first.enabled,
        oldest=str(p.get("date_priority", "oldest")).strip().lower() != "newest",
        gate_gap_hours=float(_number(p.get("name_gate_date_gap_hours"), first.gate_gap_hours)),
    )
