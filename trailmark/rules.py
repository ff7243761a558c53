"""What an analysis may define for itself: channels, funnel stages, purchase segments and retention horizons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column

from trailmark.functions.channels import MEDIUM_CHANNELS, OWN_DOMAIN_PATTERN, channel_group
from trailmark.functions.labels import FREQUENCY_BANDS, frequency_group, frequency_rank
from trailmark.operators.cohorts import HORIZONS
from trailmark.operators.sessions import STAGES


@dataclass(frozen=True)
class Rules:
    """Handed to a workspace once, and by it to all tables that depend on them.

    ``own_domain``        pattern of sources that are the own site
    ``medium_channels``   (medium, channel) pairs; the first match decides
    ``stages``            event names that are funnel stages, in order, ``purchase`` among them
    ``frequency_bands``   (least purchases, label) pairs, ascending
    ``horizons``          days after the first session, in report order
    """

    own_domain: str = OWN_DOMAIN_PATTERN
    medium_channels: Sequence[tuple[str, str]] = MEDIUM_CHANNELS
    stages: Sequence[str] = STAGES
    frequency_bands: Sequence[tuple[int, str]] = FREQUENCY_BANDS
    horizons: Sequence[int] = HORIZONS

    def __post_init__(self) -> None:
        if "purchase" not in self.stages:
            raise ValueError("purchase must be a stage: revenue reports and segments are about it")
        if not self.horizons or min(self.horizons) < 0:
            raise ValueError("horizons are days after the first session")
        if list(self.frequency_bands) != sorted(self.frequency_bands):
            raise ValueError("frequency bands must ascend")

    def channel(self) -> Column:
        return channel_group(own_domain=self.own_domain, medium_channels=self.medium_channels)

    def segment(self, purchases: str = "purchase_count") -> Column:
        return frequency_group(purchases, self.frequency_bands)

    def segment_rank(self) -> Column:
        return frequency_rank(bands=self.frequency_bands)


#: The rules that the fixed values state.
DEFAULT = Rules()
