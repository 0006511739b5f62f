"""Settings as dataclasses filled from mappings or files; unknown keys are errors."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path
from typing import Any, TypeVar

T = TypeVar("T")


def from_mapping(kind: type[T], values: dict[str, Any]) -> T:
    known = {f.name for f in dataclasses.fields(kind)}
    unknown = set(values) - known
    if unknown:
        raise KeyError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    return kind(**values)


def read_mapping(path: str) -> dict[str, Any]:
    """Of a JSON file, or a YAML file where a YAML library is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def load(kind: type[T], path: str, section: str | None = None) -> T:
    """Settings of a file, or of one section of it."""
    values = read_mapping(path)
    return from_mapping(kind, values[section] if section else values)


def rooted(path: str, base: str) -> str:
    """A relative path under an explicit base; absolute ones stay."""
    return path if path.startswith("/") or "://" in path else str(Path(base) / path)
