"""A registry of builders by category and name, with what a caller needs to know about each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Entry:
    category: str
    name: str
    build: Callable[..., Any]
    meta: dict[str, Any] = field(default_factory=dict)


_ENTRIES: dict[tuple[str, str], Entry] = {}


def register(category: str, name: str, **meta: Any) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Decorator: list a builder under a category. Names are unique within one."""

    def put(build: Callable[..., Any]) -> Callable[..., Any]:
        if (category, name) in _ENTRIES:
            raise ValueError(f"{category} already has {name!r}")
        _ENTRIES[category, name] = Entry(category, name, build, meta)
        return build

    return put


def names(category: str, **meta: Any) -> list[str]:
    """Registered names of a category, of those whose metadata has the given values."""
    return sorted(n for (c, n), e in _ENTRIES.items() if c == category and all(e.meta.get(k) == v for k, v in meta.items()))


def entry(category: str, name: str) -> Entry:
    try:
        return _ENTRIES[category, name]
    except KeyError:
        raise ValueError(f"{name!r} is not one of {category}: {', '.join(names(category))}") from None


def get(category: str, name: str) -> Callable[..., Any]:
    return entry(category, name).build


def tree() -> dict[str, list[str]]:
    """All names by category."""
    out: dict[str, list[str]] = {}
    for category, name in sorted(_ENTRIES):
        out.setdefault(category, []).append(name)
    return out
