"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracle.tables import HORIZONS, prefix


def _pct(part: str, whole: str) -> str:
    """A non-negative count in percent of another, exactly rounded to two decimals, halves up."""
    return f"((20000 * ({part}) + ({whole})) // (2 * nullif({whole}, 0)))::DOUBLE / 100"


def _share(column: str) -> str:
    return _pct(column, f"sum({column}) OVER ()")


def _micros(column: str) -> str:
    """Aggregate: sum of a column in whole micro units."""
    return f"sum(({column}::DECIMAL(18, 6) * 1000000)::BIGINT)"


def _cents_each(micros: str, whole: str) -> str:
    """Non-negative micro units per ``whole``, exactly rounded to two decimals, halves up."""
    return f"((2 * ({micros}) + 10000 * ({whole})) // (20000 * nullif({whole}, 0)))::DOUBLE / 100"


def _money_pct(micros: str, total: str) -> str:
    """Non-negative micro units in percent of others, exactly rounded to two decimals, halves up."""
    return f"((20000 * ({micros}) + ({total})) // (2 * nullif({total}, 0)))::DOUBLE / 100"


# Stage flag columns with their names in the funnel reports.
_FLAGS = (
    "view_item_flag", "add_to_cart_flag", "begin_checkout_flag",
    "add_shipping_info_flag", "add_payment_info_flag", "purchase_flag",
)
_SESSION_COUNTS = (
    "view_item_sessions", "add_to_cart_sessions", "checkout_sessions",
    "shipping_info_sessions", "payment_info_sessions", "purchase_sessions",
)

_PROFILE = {
    "profile_event_distribution":
        "SELECT event_name, count(*) AS event_count FROM log GROUP BY event_name",
    "profile_dataset": """
        SELECT min(strptime(event_date, '%Y%m%d'))::DATE AS earliest_event_date,
               max(strptime(event_date, '%Y%m%d'))::DATE AS latest_event_date,
               count(*) AS total_events, count(DISTINCT user_pseudo_id) AS distinct_users
        FROM log""",
    "profile_session_id_completeness": f"""
        SELECT count(*) AS total_events, count(ga_session_id) AS events_with_session_id,
               count(*) - count(ga_session_id) AS events_without_session_id,
               {_pct("count(ga_session_id)", "count(*)")} AS session_id_completeness_pct
        FROM log""",
    "profile_user_id_completeness": f"""
        SELECT count(*) AS total_events, count(user_pseudo_id) AS events_with_user_id,
               count(*) - count(user_pseudo_id) AS events_without_user_id,
               {_pct("count(user_pseudo_id)", "count(*)")} AS user_id_completeness_pct
        FROM log""",
    "profile_volumes": """
        SELECT count(DISTINCT user_pseudo_id) AS total_distinct_users,
               count(DISTINCT user_pseudo_id || '-' || ga_session_id) AS total_distinct_sessions,
               count(*) AS total_events
        FROM log""",
    "profile_top_sessions": """
        SELECT user_pseudo_id, unique_session_id, count(*) AS event_count
        FROM hits GROUP BY ALL ORDER BY event_count DESC, unique_session_id LIMIT 20""",
    "profile_sessions_per_user": """
        SELECT count(*) AS total_distinct_users, sum(n)::BIGINT AS total_distinct_sessions,
               ((200 * sum(n) + count(*)) // (2 * nullif(count(*), 0)))::DOUBLE / 100 AS average_sessions_per_user,
               min(n) AS minimum_sessions_per_user, max(n) AS maximum_sessions_per_user
        FROM (SELECT count(DISTINCT unique_session_id) AS n FROM hits GROUP BY user_pseudo_id)""",
    "profile_session_frequency": f"""
        SELECT n AS sessions_per_user, number_of_users,
               {_share("number_of_users")} AS percentage_of_users
        FROM (SELECT n, count(*) AS number_of_users
              FROM (SELECT count(DISTINCT unique_session_id) AS n
                    FROM hits GROUP BY user_pseudo_id) GROUP BY n)""",
    "check_duplicate_params": """
        SELECT k.param_key, count(r.event_id) AS events_with_repeats
        FROM (SELECT unnest(['ga_session_id', 'ga_session_number', 'source', 'medium',
                             'campaign']) AS param_key) k
        LEFT JOIN (
            SELECT event_id, param_key FROM (
                SELECT event_id, unnest([
                    CASE WHEN ga_session_id IS NOT NULL THEN 'ga_session_id' END,
                    CASE WHEN ga_session_number IS NOT NULL THEN 'ga_session_number' END,
                    CASE WHEN event_source IS NOT NULL THEN 'source' END,
                    CASE WHEN event_medium IS NOT NULL THEN 'medium' END,
                    CASE WHEN event_campaign IS NOT NULL THEN 'campaign' END]) AS param_key
                FROM log)
            GROUP BY ALL HAVING count(*) > 1) r USING (param_key)
        GROUP BY k.param_key""",
}

_BEHAVIOUR = {
    "new_vs_returning_funnel": f"""
        SELECT *,
               {_pct("view_item_sessions", "total_sessions")} AS view_item_rate,
               {_pct("add_to_cart_sessions", "total_sessions")} AS add_to_cart_rate,
               {_pct("checkout_sessions", "total_sessions")} AS checkout_rate,
               {_pct("shipping_info_sessions", "total_sessions")} AS shipping_info_rate,
               {_pct("payment_info_sessions", "total_sessions")} AS payment_info_rate,
               {_pct("purchase_sessions", "total_sessions")} AS purchase_rate,
               {_pct("add_to_cart_sessions", "view_item_sessions")} AS view_to_cart_pct,
               {_pct("checkout_sessions", "add_to_cart_sessions")} AS cart_to_checkout_pct,
               {_pct("shipping_info_sessions", "checkout_sessions")} AS checkout_to_shipping_pct,
               {_pct("payment_info_sessions", "shipping_info_sessions")} AS shipping_to_payment_pct,
               {_pct("purchase_sessions", "payment_info_sessions")} AS payment_to_purchase_pct
        FROM (
            SELECT CASE WHEN number = 1 THEN 'New' WHEN number > 1 THEN 'Returning' END
                       AS session_type,
                   count(*) AS total_sessions,
                   count(*) FILTER (WHERE list_contains(names, 'view_item')) AS view_item_sessions,
                   count(*) FILTER (WHERE list_contains(names, 'add_to_cart'))
                       AS add_to_cart_sessions,
                   count(*) FILTER (WHERE list_contains(names, 'begin_checkout'))
                       AS checkout_sessions,
                   count(*) FILTER (WHERE list_contains(names, 'add_shipping_info'))
                       AS shipping_info_sessions,
                   count(*) FILTER (WHERE list_contains(names, 'add_payment_info'))
                       AS payment_info_sessions,
                   count(*) FILTER (WHERE list_contains(names, 'purchase')) AS purchase_sessions
            FROM (SELECT unique_session_id, ga_session_number AS number,
                         list(DISTINCT event_name) AS names
                  FROM hits WHERE ga_session_number IS NOT NULL GROUP BY ALL)
            GROUP BY session_type)""",
}

_TRAFFIC = {
    "traffic_user_mediums": "SELECT DISTINCT first_medium AS acquisition_medium FROM log",
    "traffic_user_sources": "SELECT DISTINCT first_source AS acquisition_source FROM log",
    "traffic_user_campaigns": "SELECT DISTINCT first_campaign AS acquisition_campaign FROM log",
    "traffic_event_sources": "SELECT DISTINCT event_source FROM log",
    "traffic_event_mediums": "SELECT DISTINCT event_medium FROM log",
    "traffic_event_campaigns": "SELECT DISTINCT event_campaign FROM log",
    "traffic_completeness_by_event": f"""
        SELECT event_name, count(*) AS total_events,
               count(event_source) AS events_with_source,
               count(event_medium) AS events_with_medium,
               count(event_campaign) AS events_with_campaign,
               {_pct("count(event_source)", "count(*)")} AS source_completeness_pct,
               {_pct("count(event_medium)", "count(*)")} AS medium_completeness_pct,
               {_pct("count(event_campaign)", "count(*)")} AS campaign_completeness_pct
        FROM log GROUP BY event_name""",
    "traffic_cooccurrence": """
        SELECT sum(n)::BIGINT AS total_events,
               sum(n * s)::BIGINT AS events_with_source,
               sum(n * m)::BIGINT AS events_with_medium,
               sum(n * c)::BIGINT AS events_with_campaign,
               sum(n * s * m * c)::BIGINT AS events_with_all_three,
               sum(n * s * m)::BIGINT AS events_with_source_and_medium,
               sum(n * s * (1 - m))::BIGINT AS source_without_medium,
               sum(n * m * (1 - s))::BIGINT AS medium_without_source,
               sum(n * s * (1 - c))::BIGINT AS source_without_campaign
        FROM (SELECT (event_source IS NOT NULL)::INT AS s, (event_medium IS NOT NULL)::INT AS m,
                     (event_campaign IS NOT NULL)::INT AS c, count(*) AS n
              FROM log GROUP BY ALL)""",
    "session_attribution_coverage": f"""
        SELECT *, {_pct("attributed_sessions", "total_sessions")} AS attributed_sessions_pct,
               {_pct("unattributed_sessions", "total_sessions")} AS unattributed_sessions_pct
        FROM (SELECT count(*) AS total_sessions, count(session_source) AS attributed_sessions,
                     count(*) - count(session_source) AS unattributed_sessions,
                     count(session_campaign) AS sessions_with_campaign
              FROM (SELECT DISTINCT unique_session_id FROM hits)
              LEFT JOIN touches USING (unique_session_id))""",
}

_ACQUISITION_COLUMNS = """unique_session_id, user_pseudo_id, ga_session_id, ga_session_number,
               earliest_event_timestamp, first_traffic_event_timestamp,
               session_source, session_medium, session_campaign"""
_MARKETING = f"""
        SELECT {_ACQUISITION_COLUMNS}, channel_group, {", ".join(_FLAGS)}, session_revenue_usd
        FROM marketing"""

_MODELS = {
    "session_acquisition": f"SELECT {_ACQUISITION_COLUMNS} FROM acquisition",
    "session_ecommerce_performance": "SELECT * FROM ecommerce",
    "session_marketing_performance": _MARKETING,
    "session_marketing_fused": _MARKETING,
    "session_model_final": "SELECT * FROM final",
    "user_purchase_frequency": "SELECT * FROM purchasers",
}

_SOURCES = {
    "sessions_by_source_medium": f"""
        SELECT *, {_share("sessions")} AS session_share_pct
        FROM (SELECT session_source, session_medium, count(*) AS sessions
              FROM acquisition GROUP BY ALL)""",
    "self_referral_traffic": f"""
        SELECT count(*) AS self_referral_sessions,
               {_pct("count(*)", "(SELECT count(*) FROM acquisition)")}
                   AS self_referral_session_share_pct
        FROM acquisition
        WHERE contains(session_source, 'googlemerchandise') AND session_medium = 'referral'""",
    "sessions_by_channel": f"""
        SELECT *, {_share("sessions")} AS session_share_pct
        FROM (SELECT channel_group, count(*) AS sessions FROM channelled GROUP BY ALL)""",
    "other_channel_breakdown": f"""
        SELECT *, {_share("sessions")} AS pct_within_other_channel
        FROM (SELECT session_source, session_medium, count(*) AS sessions
              FROM channelled WHERE channel_group = 'Other' GROUP BY ALL)""",
}


def _value(keys: str, condition: str = "true", having: str = "true") -> str:
    """Sessions, purchases and revenue per group, with the derived ratios."""
    return f"""
        SELECT {keys}, total_sessions, purchase_sessions,
               {_cents_each("revenue", "1")} AS total_revenue_usd,
               {_pct("purchase_sessions", "total_sessions")} AS purchase_session_rate,
               {_cents_each("revenue", "total_sessions")} AS revenue_per_session_usd,
               {_cents_each("revenue", "purchase_sessions")} AS avg_revenue_per_purchasing_session_usd
        FROM (SELECT {keys}, count(*) AS total_sessions,
                     sum(purchase_flag)::BIGINT AS purchase_sessions,
                     {_micros("session_revenue_usd")} AS revenue
              FROM marketing WHERE {condition} GROUP BY ALL)
        WHERE {having}"""


_PERFORMANCE = {
    "channel_funnel": f"""
        SELECT *, {_pct("product_view_sessions", "total_sessions")} AS product_view_rate,
               {_pct("add_to_cart_sessions", "total_sessions")} AS add_to_cart_rate,
               {_pct("checkout_sessions", "total_sessions")} AS checkout_rate,
               {_pct("shipping_info_sessions", "total_sessions")} AS shipping_info_rate,
               {_pct("payment_info_sessions", "total_sessions")} AS payment_info_rate,
               {_pct("purchase_sessions", "total_sessions")} AS purchase_session_rate
        FROM (SELECT channel_group, count(*) AS total_sessions,
                     count(*) FILTER (WHERE view_item_flag = 1) AS product_view_sessions,
                     count(*) FILTER (WHERE add_to_cart_flag = 1) AS add_to_cart_sessions,
                     count(*) FILTER (WHERE begin_checkout_flag = 1) AS checkout_sessions,
                     count(*) FILTER (WHERE add_shipping_info_flag = 1) AS shipping_info_sessions,
                     count(*) FILTER (WHERE add_payment_info_flag = 1) AS payment_info_sessions,
                     count(*) FILTER (WHERE purchase_flag = 1) AS purchase_sessions
              FROM marketing GROUP BY channel_group)""",
    "channel_revenue": f"""
        SELECT v.*, s.revenue_share_pct
        FROM ({_value("channel_group")}) v
        JOIN (SELECT channel_group,
                     {_money_pct("revenue", "sum(revenue) OVER ()")} AS revenue_share_pct
              FROM (SELECT channel_group, {_micros("session_revenue_usd")} AS revenue
                    FROM marketing GROUP BY ALL)) s USING (channel_group)""",
    "source_medium_performance": _value(
        "session_source, session_medium",
        """channel_group NOT IN ('Self-referral', 'Unattributed', 'Data Unavailable')
           AND session_source NOT IN ('<Other>', '(data deleted)')
           AND session_source IS NOT NULL AND session_medium IS NOT NULL""",
        "total_sessions >= 100",
    ),
    "campaign_distribution": f"""
        SELECT *, {_share("total_sessions")} AS session_share_pct
        FROM (SELECT session_campaign, count(*) AS total_sessions FROM marketing GROUP BY ALL)""",
    "named_campaign_performance": _value(
        "session_campaign, session_source, session_medium",
        """session_campaign IS NOT NULL AND session_campaign NOT IN
           ('(organic)', '(referral)', '(direct)', '<Other>', '(data deleted)')""",
    ),
}


def _row_count(name: str, table: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, count(*) AS rows, "
        f"count(DISTINCT unique_session_id) AS distinct_sessions FROM {table}"
    )


_TYPE_OR_UNKNOWN = (
    "CASE WHEN ga_session_number = 1 THEN 'New' WHEN ga_session_number > 1 THEN 'Returning' "
    "ELSE 'Unknown' END"
)

_CHECKS = {
    "check_duplicate_sessions": """
        SELECT unique_session_id, count(*) AS row_count
        FROM final GROUP BY ALL HAVING count(*) > 1""",
    "check_missing_ids": """
        SELECT count(*) AS total_sessions,
               count(*) - count(unique_session_id) AS sessions_missing_unique_session_id,
               count(*) - count(user_pseudo_id) AS sessions_missing_user_id,
               count(*) - count(ga_session_id) AS sessions_missing_ga_session_id,
               count(*) - count(ga_session_number) AS sessions_missing_ga_session_number
        FROM marketing""",
    "check_model_row_counts": " UNION ALL ".join(
        [
            _row_count("session_acquisition", "acquisition"),
            _row_count("session_ecommerce_performance", "ecommerce"),
            _row_count("session_marketing_performance", "marketing"),
            _row_count("session_marketing_performance_final", "final"),
        ]
    ),
    "check_session_type_split": f"""
        SELECT *, {_share("sessions")} AS session_share_pct
        FROM (SELECT session_type, count(*) AS sessions FROM final GROUP BY ALL)""",
    "check_unclassified_sessions": """
        SELECT count(*) AS unclassified_sessions
        FROM marketing WHERE coalesce(ga_session_number, 0) < 1""",
    "check_flag_domain": """
        SELECT min(view_item_flag) AS min_view_item_flag,
               max(view_item_flag) AS max_view_item_flag,
               min(add_to_cart_flag) AS min_add_to_cart_flag,
               max(add_to_cart_flag) AS max_add_to_cart_flag,
               min(begin_checkout_flag) AS min_begin_checkout_flag,
               max(begin_checkout_flag) AS max_begin_checkout_flag,
               min(add_shipping_info_flag) AS min_shipping_flag,
               max(add_shipping_info_flag) AS max_shipping_flag,
               min(add_payment_info_flag) AS min_payment_flag,
               max(add_payment_info_flag) AS max_payment_flag,
               min(purchase_flag) AS min_purchase_flag,
               max(purchase_flag) AS max_purchase_flag
        FROM marketing""",
    "check_purchases_missing_stages": """
        SELECT (count(*) - sum(view_item_flag))::BIGINT AS purchases_without_view_item,
               (count(*) - sum(add_to_cart_flag))::BIGINT AS purchases_without_add_to_cart,
               (count(*) - sum(begin_checkout_flag))::BIGINT AS purchases_without_begin_checkout,
               (count(*) - sum(add_shipping_info_flag))::BIGINT AS purchases_without_shipping_info,
               (count(*) - sum(add_payment_info_flag))::BIGINT AS purchases_without_payment_info,
               (count(*) - sum(add_shipping_info_flag * add_payment_info_flag))::BIGINT
                   AS purchases_missing_shipping_or_payment
        FROM marketing WHERE purchase_flag = 1""",
    "check_no_cart_purchases_by_type": f"""
        SELECT {_TYPE_OR_UNKNOWN} AS session_type,
               count(*) AS purchase_sessions_without_add_to_cart
        FROM marketing WHERE purchase_flag > add_to_cart_flag GROUP BY ALL""",
    "check_purchases_by_type": f"""
        SELECT *, {_share("purchase_sessions")} AS purchase_session_share_pct
        FROM (SELECT {_TYPE_OR_UNKNOWN} AS session_type, count(*) AS purchase_sessions
              FROM marketing WHERE purchase_flag = 1 GROUP BY ALL)""",
    "check_revenue_consistency": f"""
        SELECT count(*) AS total_sessions,
               count(*) FILTER (WHERE purchase_flag = 1 AND session_revenue_usd <= 0)
                   AS purchase_sessions_without_positive_revenue,
               count(*) FILTER (WHERE purchase_flag = 0 AND session_revenue_usd > 0)
                   AS non_purchase_sessions_with_revenue,
               {_cents_each(_micros("session_revenue_usd"), "1")} AS total_revenue_usd
        FROM final""",
    "check_attribution_completeness": f"""
        SELECT *, {_pct("attributed_sessions", "total_sessions")} AS attributed_session_pct
        FROM (SELECT count(*) AS total_sessions, count(session_source) AS attributed_sessions,
                     count(*) - count(session_source) AS sessions_with_incomplete_attribution
              FROM marketing)""",
    "purchase_frequency_distribution": f"""
        SELECT *, {_share("purchasers")} AS purchaser_share_pct
        FROM (SELECT frequency_group, count(*) AS purchasers FROM purchasers GROUP BY ALL)""",
    "repeat_purchaser_rate": f"""
        SELECT *, {_pct("repeat_purchasers", "total_purchasers")} AS repeat_purchaser_rate,
               {_pct("one_time_purchasers", "total_purchasers")} AS one_time_purchaser_rate
        FROM (SELECT count(*) AS total_purchasers,
                     count(*) FILTER (WHERE purchase_count > 1) AS repeat_purchasers,
                     count(*) FILTER (WHERE purchase_count = 1) AS one_time_purchasers
              FROM purchasers)""",
}

def _retention(horizons) -> dict[str, str]:
    """Statements on the cohort tables, and those that show their horizons."""
    counts = [f"d{n}_{state}_users" for n in horizons for state in ("eligible", "retained")]
    measures = "cohort_size, " + ", ".join(
        f"d{n}_eligible_users, d{n}_retained_users, d{n}_retention_rate" for n in horizons
    )

    def totals(table: str) -> str:
        rates = ", ".join(
            f"{_pct(f'd{n}_retained_users', f'd{n}_eligible_users')} AS overall_d{n}_retention_rate" for n in horizons
        )
        sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in counts)
        return f"SELECT *, {rates} FROM (SELECT sum(cohort_size)::BIGINT AS cohort_users, {sums} FROM {table})"

    def reconcile() -> str:
        columns = ", ".join(
            f"w.{c} AS weekly_{n}, c.{c} AS channel_{n}, w.{c} = c.{c} AS {n}_match"
            for c, n in [("cohort_users", "cohort_users"), *[(c, c.removesuffix("_users")) for c in counts]]
        )
        return f"SELECT {columns} FROM ({totals('weekly')}) w, ({totals('by_channel')}) c"

    def impossible(model: str, table: str) -> str:
        broken = " OR ".join(f"d{n}_retained_users > d{n}_eligible_users" for n in horizons)
        return f"SELECT '{model}' AS model, count(*) AS invalid_rows FROM {table} WHERE {broken}"

    eligible = ", ".join(f"d{n}_eligible_users" for n in horizons)
    shares = ", ".join(f"{_pct(f'd{n}_eligible_users', 'cohort_size')} AS d{n}_eligibility_pct" for n in horizons)
    return {
        "weekly_cohort_retention": f"SELECT cohort_week, {measures} FROM weekly",
        "channel_retention": f"SELECT channel_group, {measures} FROM by_channel",
        "retention_totals_weekly": totals("weekly"),
        "retention_totals_channel": totals("by_channel"),
        "retention_reconcile": reconcile(),
        "retention_review_channel": f"SELECT channel_group, {measures} FROM by_channel",
        "retention_review_weekly": f"SELECT cohort_week, {measures} FROM weekly",
        "check_impossible_retention": impossible("Weekly Cohort", "weekly")
        + " UNION ALL "
        + impossible("Channel Retention", "by_channel"),
        "cohort_eligibility": f"SELECT cohort_week, cohort_size, {eligible}, {shares} FROM weekly",
        "cohort_matrix": " UNION ALL ".join(
            f"SELECT cohort_week, cohort_size, 'D{n}' AS horizon, d{n}_retention_rate AS retention_rate FROM weekly"
            for n in horizons
        ),
        "retention_overview": totals("weekly"),
        "retention_rates": f"SELECT cohort_month, {measures} FROM monthly",
    }


def _kpis(keys: str = "", condition: str = "true") -> str:
    head = f"{keys}, " if keys else ""
    return f"""
        SELECT {head}count(DISTINCT user_pseudo_id) AS users, count(*) AS sessions,
               sum(purchase_flag)::BIGINT AS purchase_sessions,
               {_cents_each(_micros("session_revenue_usd"), "1")} AS revenue_usd,
               {_pct("sum(purchase_flag)::BIGINT", "count(*)")} AS conversion_rate,
               {_cents_each(_micros("session_revenue_usd"), "count(*)")} AS revenue_per_session_usd
        FROM final WHERE {condition} GROUP BY ALL"""


_DASHBOARDS = {
    "kpi_summary": _kpis(),
    "kpi_summary_filtered": _kpis(
        condition="""session_date BETWEEN DATE '2020-12-01' AND DATE '2020-12-31'
                     AND channel_group IN ('Direct', 'Organic Search')"""
    ),
    "performance_over_time": _kpis("session_date"),
    "performance_by_month": _kpis("session_month"),
    "channel_overview": _kpis("channel_group"),
    "user_type_value": f"""
        SELECT session_type, sessions, {_share("sessions")} AS session_share_pct,
               purchase_sessions, {_pct("purchase_sessions", "sessions")} AS conversion_rate,
               {_cents_each("revenue", "1")} AS revenue_usd,
               {_money_pct("revenue", "sum(revenue) OVER ()")} AS revenue_share_pct,
               {_cents_each("revenue", "sessions")} AS revenue_per_session_usd
        FROM (SELECT session_type, count(*) AS sessions,
                     sum(purchase_flag)::BIGINT AS purchase_sessions,
                     {_micros("session_revenue_usd")} AS revenue
              FROM final GROUP BY ALL)""",
    "user_type_funnel_from_view": "SELECT session_type, view_sessions, "
    + ", ".join(
        f"{s}_sessions, {_pct(f'{s}_sessions', 'view_sessions')} AS {s}_pct"
        for s in ("add_to_cart", "begin_checkout", "add_shipping_info",
                  "add_payment_info", "purchase")
    )
    + " FROM (SELECT session_type, count(*) AS view_sessions, "
    + ", ".join(
        f"count(*) FILTER (WHERE {s}_flag = 1) AS {s}_sessions"
        for s in ("add_to_cart", "begin_checkout", "add_shipping_info",
                  "add_payment_info", "purchase")
    )
    + " FROM final WHERE view_item_flag = 1 GROUP BY ALL)",
    "repeat_purchase_overview": f"""
        SELECT d.*, r.repeat_purchaser_rate
        FROM ({_CHECKS["purchase_frequency_distribution"]}) d,
             ({_CHECKS["repeat_purchaser_rate"]}) r""",
}

_BLOCKS = {
    "read_events": "SELECT event_date, count(*) AS events FROM log GROUP BY ALL",
    "event_param": """
        SELECT revenue AS purchase_revenue_usd, user_pseudo_id, ga_session_id,
               ga_session_number, event_timestamp, event_name, event_source, event_medium,
               event_campaign
        FROM log""",
    "sessionized": "SELECT unique_session_id, count(*) AS events FROM hits GROUP BY ALL",
    "first_event_where": """
        SELECT unique_session_id, first_traffic_event_timestamp, session_source, session_medium,
               session_campaign
        FROM (SELECT DISTINCT unique_session_id FROM hits)
        LEFT JOIN touches USING (unique_session_id)""",
    "channel_group": "SELECT DISTINCT session_source, session_medium, channel_group FROM channelled",
    "stage_flags": f"SELECT unique_session_id, {', '.join(_FLAGS)} FROM ecommerce",
    "session_revenue": """
        SELECT unique_session_id, session_revenue_usd FROM ecommerce""",
    "session_type": """
        SELECT unique_session_id, ga_session_number,
               CASE WHEN ga_session_number = 1 THEN 'New'
                    WHEN ga_session_number > 1 THEN 'Returning' END AS session_type
        FROM acquisition""",
    "micros_to_calendar": """
        SELECT earliest_event_timestamp,
               make_timestamp(earliest_event_timestamp)::DATE AS session_date,
               date_trunc('month', make_timestamp(earliest_event_timestamp))::DATE AS session_month,
               date_trunc('week', make_timestamp(earliest_event_timestamp))::DATE AS session_week
        FROM acquisition""",
    "analysis_window": "SELECT max(session_date) AS max_session_date FROM final",
    "user_cohorts": "SELECT * FROM cohort",
    "user_session_dates": "SELECT * FROM visits",
    "exact_day_retention": "SELECT * FROM retained",
    "frequency_group": """
        SELECT user_pseudo_id, count(DISTINCT unique_session_id) AS session_count,
               ['1 Purchase', '2 Purchases', '3+ Purchases'][
                   least(count(DISTINCT unique_session_id), 3)] AS frequency_group
        FROM hits GROUP BY user_pseudo_id""",
}

_BLOCKS |= {
    "completeness": f"""
        SELECT count(*) AS total_events, count(event_campaign) AS events_with_campaign,
               count(*) - count(event_campaign) AS events_without_campaign,
               {_pct("count(event_campaign)", "count(*)")} AS campaign_completeness_pct
        FROM log""",
    "pct_and_ratio": f"""
        SELECT make_timestamp(event_timestamp)::DATE AS day,
               {_pct("count(event_campaign)", "count(*)")} AS campaign_pct,
               {_cents_each(_micros("revenue"), "count(event_campaign)")} AS revenue_per_campaign_event
        FROM log GROUP BY ALL""",
    "share_of_total": f"""
        SELECT event_date, events, {_share("events")} AS event_share_pct
        FROM ({_BLOCKS["read_events"]})""",
    "materialize": _PERFORMANCE["channel_funnel"],
}


def all_statements(horizons=HORIZONS, **rules) -> dict[str, str]:
    """The statement of each query, for other rules (see ``oracle.tables.prefix``) too."""
    groups = (
        _PROFILE, _BEHAVIOUR, _TRAFFIC, _MODELS, _SOURCES, _PERFORMANCE, _CHECKS, _retention(horizons),
        _DASHBOARDS, _BLOCKS,
    )
    start = prefix(horizons=horizons, **rules)
    return {name: start + sql.strip() for group in groups for name, sql in group.items()}
