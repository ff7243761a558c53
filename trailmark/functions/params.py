"""Typed lookups in the event parameter list, and the session key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_param(key: str, slot: str, params: str = "event_params") -> Column:
    """Value of parameter ``key`` in ``slot`` (``string_value`` or ``int_value``).

    NULL if the key is absent; the first one if it is repeated. Written as a
    position in the key list applied to the list of one slot: unlike a lambda
    filter this is compiled, and the scan reads the keys and that slot only.
    """
    position = F.array_position(F.col(f"{params}.key"), F.lit(key)) - 1
    return F.get(F.col(f"{params}.value.{slot}"), position.cast("int"))


def string_param(key: str) -> Column:
    return event_param(key, "string_value")


def int_param(key: str) -> Column:
    return event_param(key, "int_value")


def param_count(key: str, params: str = "event_params") -> Column:
    """How often ``key`` occurs in the parameter list."""
    keys = F.col(f"{params}.key")
    return F.size(keys) - F.size(F.array_remove(keys, key))


def session_key(user: str = "user_pseudo_id", session: str = "ga_session_id") -> Column:
    """``user-session``; NULL as soon as one part is NULL."""
    return F.concat(F.col(user), F.lit("-"), F.col(session).cast("string"))
