"""Derived tables of one event log, built on first use and stored as parquet."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.cohorts import (
    retention_long,
    retention_wide,
    user_calendars,
    with_horizons,
)
from trailmark.operators.sessions import session_facts
from trailmark.plans import models
from trailmark.rules import DEFAULT, Rules
from trailmark.sources.tables import by_month_and_day, write_bucketed, write_files


class Workspace:
    """Tables under ``root``; each is written once and then only read.

    Events are scanned once, into ``session_facts``, laid out by month and sorted by day.
    Acquisition, marketing and final session tables are projections of it, so they cost
    no further storage; :meth:`write_all` stores every table by name for use elsewhere.
    ``root`` must be reachable from all executors. Without it nothing is stored and every
    table is computed from the events when used. All tables follow the same ``rules``.
    """

    def __init__(
        self,
        events: Callable[[], DataFrame],
        root: str | None,
        rules: Rules = DEFAULT,
    ):
        self._events = events
        self._root = root
        self.rules = rules
        self._stored: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}
        self._lock = threading.RLock()

    def stored(
        self, name: str, build: Callable[[], DataFrame], folders: Sequence[str] = ()
    ) -> DataFrame:
        """The table ``name``, written from ``build`` on first use."""
        with self._lock:
            if name not in self._stored:
                if self._root is None:
                    return build()
                self._stored[name] = write_files(build(), f"{self._root}/{name}", folders)
            return self._stored[name]

    def bucketed(self, name: str, build: Callable[[], DataFrame], key: str) -> DataFrame:
        """The table ``name`` dealt into buckets by ``key``, one for each shuffle partition of the session."""
        with self._lock:
            if name not in self._stored:
                if self._root is None:
                    return build()
                df = build()
                buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                self._stored[name] = write_bucketed(
                    df, f"{self._root}/{name}", f"{name}_{uuid.uuid4().hex}", key, buckets
                )
            return self._stored[name]

    def _view(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A projection of stored tables; only its plan is kept."""
        with self._lock:
            if name not in self._views:
                self._views[name] = build()
            return self._views[name]

    def events(self) -> DataFrame:
        return self._events()

    def facts(self) -> DataFrame:
        def build() -> DataFrame:
            facts = models.classified(session_facts(self.events(), self.rules.stages), self.rules)
            if self._root is None:
                return facts
            return by_month_and_day(facts, "session_month", "session_date", "channel_group")

        return self.stored("session_facts", build, ["session_month"])

    def acquisition(self) -> DataFrame:
        return self._view("acquisition", lambda: models.acquisition_of(self.facts()))

    def ecommerce(self) -> DataFrame:
        return self._view("ecommerce", lambda: models.ecommerce_of(self.facts(), self.rules))

    def marketing(self) -> DataFrame:
        return self._view(
            "marketing", lambda: self.facts().select(*models.marketing_columns(self.rules))
        )

    def joined_marketing(self) -> DataFrame:
        """The marketing table from the stored acquisition and ecommerce tables, which share their buckets."""
        key = "unique_session_id"
        return models.session_marketing_performance(
            self.bucketed("acquisition_by_session", self.acquisition, key),
            self.bucketed("ecommerce_by_session", self.ecommerce, key),
            self.rules,
        )

    def sessions(self) -> DataFrame:
        """The final session table."""
        return self._view("sessions", lambda: models.final_of(self.facts(), self.rules))

    def purchasers(self) -> DataFrame:
        return self.stored(
            "user_purchase_frequency",
            lambda: models.user_purchase_frequency(self.sessions(), self.rules),
        )

    def calendars(self) -> DataFrame:
        """Each user's first session and days with sessions, from which any horizon is read."""
        return self.stored("user_calendars", lambda: user_calendars(self.sessions()))

    def retention_users(self, horizons: Sequence[int] | None = None) -> DataFrame:
        return with_horizons(self.calendars(), horizons or self.rules.horizons)

    def weekly_retention_long(self) -> DataFrame:
        """Counts of each weekly cohort and horizon, in a row each."""
        return self.stored(
            "cohort_weekly_retention_long",
            lambda: retention_long(self.retention_users(), "cohort_week", self.rules.horizons),
        )

    def channel_retention_long(self) -> DataFrame:
        channel = F.col("first_session_channel").alias("channel_group")
        return self.stored(
            "channel_retention_long",
            lambda: retention_long(self.retention_users(), channel, self.rules.horizons),
        )

    def weekly_retention(self) -> DataFrame:
        """The weekly cohorts with the rules' horizons side by side."""
        return self.stored(
            "cohort_weekly_retention",
            lambda: retention_wide(self.weekly_retention_long(), self.rules.horizons),
        )

    def channel_retention(self) -> DataFrame:
        return self.stored(
            "channel_retention",
            lambda: retention_wide(self.channel_retention_long(), self.rules.horizons),
        )

    def write_all(self, write: Callable[[DataFrame, str], DataFrame]) -> dict[str, DataFrame]:
        """Hand each of the seven derived tables and its name to ``write``, such as ``replace_table``."""
        tables = {
            "session_acquisition": self.acquisition,
            "session_ecommerce_performance": self.ecommerce,
            "session_marketing_performance": self.marketing,
            "session_marketing_performance_final": self.sessions,
            "user_purchase_frequency": self.purchasers,
            "cohort_weekly_retention": self.weekly_retention,
            "channel_retention": self.channel_retention,
        }
        return {name: write(build(), name) for name, build in tables.items()}
