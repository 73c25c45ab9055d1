"""What a Python worker process remembers between tasks: one thing at a time, so that stages that follow one another in a worker don't add up."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_held: dict[tuple, Any] = {}


def remembered(*key, make: Callable[[], Any]) -> Any:
    """What make() gave for this key in this process, if nothing else was asked for meanwhile."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    _held.clear()
