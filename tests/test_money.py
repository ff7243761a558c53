"""Money in reports and tables does not depend on partitions."""

import pytest

import __spark_entry__ as registry
from oracle.compare import connect, difference
from oracle.statements import all_statements

SF_DIR = "/root/testdata/sf0.01"
REPORTS = (
    "kpi_summary", "kpi_summary_filtered", "performance_over_time", "performance_by_month",
    "channel_overview", "user_type_value", "channel_revenue", "source_medium_performance",
    "named_campaign_performance", "check_revenue_consistency", "pct_and_ratio",
)
TABLES = ("session_revenue", "session_ecommerce_performance", "session_model_final", "user_purchase_frequency")


@pytest.mark.parametrize("partitions", [1, 16, 200])
def test_reports_equal_sql(spark, partitions):
    con, before = connect(SF_DIR), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in REPORTS + (TABLES if partitions == 16 else ()):
            assert difference(registry.queries()[name](spark, SF_DIR), con, all_statements()[name]) is None, name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
