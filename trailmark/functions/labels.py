"""Session type and purchase-frequency labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session types, and the purchase-frequency segments in report order, each with the least count in it.
NEW = "New"
RETURNING = "Returning"
UNKNOWN = "Unknown"
FREQUENCY_BANDS = ((1, "1 Purchase"), (2, "2 Purchases"), (3, "3+ Purchases"))


def session_type(number: str = "ga_session_number", unknown: str | None = None) -> Column:
    """New for session number 1, Returning above, else ``unknown`` (NULL by default)."""
    n = F.col(number)
    return F.when(n == 1, NEW).when(n > 1, RETURNING).otherwise(F.lit(unknown).cast("string"))


def frequency_group(
    purchases: str = "purchase_count", bands: Sequence[tuple[int, str]] = FREQUENCY_BANDS
) -> Column:
    """Segment of a purchase count: the last of the ascending ``bands`` that it reaches, NULL below the first."""
    n, label = F.col(purchases), F
    for least, name in reversed(bands):
        label = label.when(n >= least, name)
    return label


def frequency_rank(
    group: str = "frequency_group", bands: Sequence[tuple[int, str]] = FREQUENCY_BANDS
) -> Column:
    """Sort position of a segment in reports."""
    return F.array_position(F.array(*[F.lit(name) for _, name in bands]), F.col(group))
