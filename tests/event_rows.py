"""Event log rows for tests, and the tables they read."""

from __future__ import annotations

import datetime

SF_DIR = "/root/testdata/sf0.001"


def micros(text: str) -> int:
    """Epoch microseconds of a UTC time such as ``2020-11-05 23:59:00``."""
    at = datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc)
    return int(at.timestamp()) * 1_000_000


def event(
    at: str,
    user: str | None = "u1",
    session: int | None = 1,
    number: int | None = 1,
    name: str = "page_view",
    source: str | None = None,
    medium: str | None = None,
    campaign: str | None = None,
    revenue: float | None = None,
    extra: tuple = (),
    day: str | None = None,
) -> tuple:
    """One event log row in the order of ``EVENT_SCHEMA``."""
    params = []
    for key, value in (("ga_session_id", session), ("ga_session_number", number)):
        if value is not None:
            params.append((key, (None, value)))
    for key, value in (("source", source), ("medium", medium), ("campaign", campaign)):
        if value is not None:
            params.append((key, (value, None)))
    params += [(key, (value, None)) for key, value in extra]
    stamp = micros(at)
    return (
        stamp,
        name,
        user,
        params,
        (None, None, None),
        (revenue,),
        day or at[:10].replace("-", ""),
    )
