"""Settings as frozen dataclasses; a change gives new settings and is checked before it counts."""

from __future__ import annotations

import copy
import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class Mapping:
    """Names of the input's columns; ``source``/``source_name`` default to fixed values where no column is named."""

    summary: str = "question"
    document: str = "answer"
    source: str | None = None
    source_name: str | None = None
    parent: str | None = None
    chunk: str | None = None
    default_source: str = "qa"
    default_source_name: str = "default"


@dataclass(frozen=True)
class Dialogue:
    max_tokens: int = 1024
    threshold: float = 0.7
    cut_scale: int = 2

    def __post_init__(self):
        if self.cut_scale < 2:
            raise ValueError("cut_scale must be 2 or more")


@dataclass(frozen=True)
class Settings:
    collection: str = "records"
    dimension: int = 64
    bm25: Bm25 = field(default_factory=Bm25)
    mapping: Mapping = field(default_factory=Mapping)
    dialogue: Dialogue = field(default_factory=Dialogue)


def expand_path(path: str, value: Any) -> dict:
    """``a.b[0].c`` as nested dicts and lists; a list is padded with empty dicts up to its index."""
    steps: list[str | int] = [int(i) if i else name for name, i in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path)]
    for step in reversed(steps):
        value = [*({} for _ in range(step)), value] if isinstance(step, int) else {step: value}
    return value


def deep_merge(old: Any, new: Any) -> Any:
    """Dicts merge by key, lists by position; anything else is replaced."""
    if isinstance(old, dict) and isinstance(new, dict):
        return old | {k: deep_merge(old[k], v) if k in old else v for k, v in new.items()}
    if isinstance(old, list) and isinstance(new, list):
        return [deep_merge(a, b) for a, b in zip(old, new, strict=False)] + old[len(new) :] + new[len(old) :]
    return copy.deepcopy(new)


def _build(kind: type, values: dict) -> Any:
    known = {f.name: f for f in fields(kind)}
    if extra := values.keys() - known.keys():
        raise ValueError(f"unknown settings: {sorted(extra)}")
    defaults = kind()
    return kind(**{k: _build(type(getattr(defaults, k)), v) if is_dataclass(getattr(defaults, k)) else v for k, v in values.items()})


def with_changes(settings: Settings, changes: dict | list[tuple[str, Any]]) -> Settings:
    """New settings: ``changes`` is a nested dict, a dict of dotted paths, or pairs of path and value."""
    merged = asdict(settings)
    for path, value in changes.items() if isinstance(changes, dict) else changes:
        merged = deep_merge(merged, expand_path(path, value))
    return _build(Settings, merged)


def load(path: str | Path) -> Settings:
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(path)
    return _build(Settings, yaml.safe_load(Path(path).read_text()) or {})


def save(settings: Settings, path: str | Path) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(asdict(settings), allow_unicode=True))
