"""Python workers outlive stages, and so do the caches of operators: only the operator at work keeps its own."""

from __future__ import annotations

from collections.abc import Callable

_CLEAR: dict[str, Callable[[], None]] = {}
_OWNER = [""]


def register(name: str, clear: Callable[[], None]) -> None:
    _CLEAR[name] = clear


def claim(name: str) -> None:
    """Called at the start of a worker's task; drops what other operators hold in this process."""
    if _OWNER[0] == name:
        return
    for other, clear in _CLEAR.items():
        if other != name:
            clear()
    _OWNER[0] = name
