"""Times of the engine's tests."""

from __future__ import annotations

import datetime as dt

UTC = dt.UTC


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def utc(value: dt.datetime | None) -> dt.datetime | None:
    """Collected timestamps come back in the machine's zone, which the tests do not rely on."""
    return None if value is None else value.astimezone(UTC)
