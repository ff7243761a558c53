"""The nested event log: one row per event, stored by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The observation period of the analysis, as inclusive yyyyMMdd days.
PERIOD_START = "20201101"
PERIOD_END = "20210131"

_PARAM_VALUE = T.StructType(
    [
        T.StructField("string_value", T.StringType()),
        T.StructField("int_value", T.LongType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField(
            "event_params",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("key", T.StringType()),
                        T.StructField("value", _PARAM_VALUE),
                    ]
                )
            ),
        ),
        T.StructField(
            "traffic_source",
            T.StructType(
                [
                    T.StructField("medium", T.StringType()),
                    T.StructField("source", T.StringType()),
                    T.StructField("name", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "ecommerce",
            T.StructType([T.StructField("purchase_revenue_in_usd", T.DoubleType())]),
        ),
        T.StructField("event_date", T.StringType()),
    ]
)


def within_days(events: DataFrame, start: str, end: str) -> DataFrame:
    """Events of the days ``start`` to ``end``, both included."""
    return events.filter(F.col("event_date").between(start, end))


def read_events(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Read the days ``start`` to ``end`` of an event log partitioned by ``event_date``.

    The schema is given, so no inference job runs and the day stays a string; the
    range turns into a partition filter, so other days are never listed as input.
    """
    return within_days(spark.read.schema(EVENT_SCHEMA).parquet(path), start, end)

