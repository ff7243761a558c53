"""Common table expressions: event log, session tables, user tables, cohorts."""

# The event log of FIXTURES.md, one flat row per event.
EVENT_LOG = """
traffic(lo, hi, source, medium, campaign) AS (VALUES
    (44, 44, NULL, 'organic', NULL),
    (45, 54, '(direct)', '(none)', '(direct)'),
    (55, 62, 'google', 'organic', '(organic)'),
    (63, 65, 'google', 'cpc', 'holiday_sale'),
    (66, 67, 'google', 'cpc', NULL),
    (68, 73, 'shop.googlemerchandisestore.com', 'referral', '(referral)'),
    (74, 79, 'partner.example', 'referral', '(referral)'),
    (80, 83, 'newsletter', 'email', 'nov_news'),
    (84, 87, 'affil.example', 'affiliate', '<Other>'),
    (88, 91, '<Other>', '<Other>', '<Other>'),
    (92, 94, '(data deleted)', '(data deleted)', '(data deleted)'),
    (95, 97, 'youtube', 'video', 'brand_video'),
    (98, 99, 'solo', NULL, 'orphan')
),
user_traffic(rest, medium, source, name) AS (VALUES
    (0, 'organic', 'google', '(organic)'),
    (1, '(none)', '(direct)', '(direct)'),
    (2, '<Other>', '<Other>', '<Other>'),
    (4, 'referral', 'shop.googlemerchandisestore.com', '(referral)')
),
timed AS (
    SELECT event_id, user_id, event_type, value, (props->>'$.k')::INT AS k,
           1604188800000000 + (user_id * 7) % 88 * 86400000000
           + (epoch_us(ts) - 1704067200000000) * (90 - (user_id * 7) % 88) // 30 AS et
    FROM events
),
breaks AS (
    SELECT *, coalesce(et - lag(et) OVER (PARTITION BY user_id ORDER BY et, event_id)
                       > 86400000000, true) AS starts
    FROM timed
),
numbered AS (
    SELECT *, count(*) FILTER (WHERE starts)
              OVER (PARTITION BY user_id ORDER BY et, event_id ROWS UNBOUNDED PRECEDING) AS sn
    FROM breaks
),
started AS (
    SELECT *, min(et) OVER (PARTITION BY user_id, sn) AS sstart FROM numbered
),
log AS (
    SELECT event_id,
           strftime(make_timestamp(et), '%Y%m%d') AS event_date,
           et AS event_timestamp,
           CASE event_type WHEN 'view' THEN 'view_item' WHEN 'click' THEN 'add_to_cart'
                WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'page_view'
                ELSE ['begin_checkout', 'add_shipping_info', 'add_payment_info'][k % 3 + 1]
           END AS event_name,
           CASE WHEN event_id % 97 <> 0 THEN 'u' || user_id END AS user_pseudo_id,
           CASE WHEN event_id % 89 <> 0 THEN sstart // 1000000 END AS ga_session_id,
           CASE WHEN event_id % 83 = 0 THEN NULL
                WHEN event_id % 101 = 0 THEN sn + 1
                WHEN user_id % 50 = 49 THEN sn - 1
                WHEN user_id % 10 = 3 THEN sn + 1
                ELSE sn END AS ga_session_number,
           t.source AS event_source, t.medium AS event_medium, t.campaign AS event_campaign,
           u.source AS first_source, u.medium AS first_medium, u.name AS first_campaign,
           CASE WHEN event_type = 'purchase' AND k % 11 <> 0 THEN value
                WHEN event_type = 'error' AND k = 7 THEN value END AS revenue
    FROM started
    LEFT JOIN traffic t ON k BETWEEN t.lo AND t.hi
    LEFT JOIN user_traffic u ON user_id % 5 = u.rest
),
hits AS (
    SELECT *, user_pseudo_id || '-' || ga_session_id AS unique_session_id
    FROM log WHERE user_pseudo_id IS NOT NULL AND ga_session_id IS NOT NULL
)"""

# What an analysis may define for itself, with the values that the reports use.
OWN_DOMAIN = "googlemerchandise"
MEDIUMS = (
    ("organic", "Organic Search"), ("cpc", "Paid Search"), ("email", "Email"), ("affiliate", "Affiliate"),
    ("referral", "Referral"), ("(data deleted)", "Data Unavailable"), ("<Other>", "Data Unavailable"),
)
STAGES = (
    "view_item", "add_to_cart", "begin_checkout", "add_shipping_info", "add_payment_info", "purchase",
)
BANDS = ((1, "1 Purchase"), (2, "2 Purchases"), (3, "3+ Purchases"))
HORIZONS = (7, 30)


def sessions(own_domain: str = OWN_DOMAIN, mediums=MEDIUMS, stages=STAGES) -> str:
    return _SESSIONS.format(
        own_domain=own_domain,
        mediums=" ".join(f"WHEN session_medium = '{m}' THEN '{label}'" for m, label in mediums),
        flags=", ".join(f"bool_or(event_name = '{s}')::INT AS {s}_flag" for s in stages),
    )


_SESSIONS = """
touches AS (
    SELECT unique_session_id, event_timestamp AS first_traffic_event_timestamp,
           event_source AS session_source, event_medium AS session_medium,
           event_campaign AS session_campaign
    FROM hits
    WHERE event_source IS NOT NULL AND event_medium IS NOT NULL
    QUALIFY row_number() OVER (
        PARTITION BY unique_session_id
        ORDER BY event_timestamp, event_source, event_medium, event_campaign NULLS FIRST) = 1
),
acquisition AS (
    SELECT s.*, t.* EXCLUDE (unique_session_id)
    FROM (SELECT unique_session_id, user_pseudo_id, ga_session_id, ga_session_number,
                 min(event_timestamp) AS earliest_event_timestamp
          FROM hits GROUP BY ALL) s
    LEFT JOIN touches t USING (unique_session_id)
),
ecommerce AS (
    SELECT unique_session_id,
           {flags},
           coalesce(sum(revenue::DECIMAL(18, 6)), 0)::DOUBLE AS session_revenue_usd
    FROM hits GROUP BY unique_session_id
),
channelled AS (
    SELECT *, CASE
        WHEN session_source IS NULL AND session_medium IS NULL THEN 'Unattributed'
        WHEN session_medium = 'referral' AND contains(session_source, '{own_domain}') THEN 'Self-referral'
        WHEN session_source = '(direct)' AND session_medium = '(none)' THEN 'Direct'
        {mediums}
        ELSE 'Other'
        END AS channel_group
    FROM acquisition
),
marketing AS (
    SELECT * FROM channelled JOIN ecommerce USING (unique_session_id)
),
final AS (
    SELECT *, make_timestamp(earliest_event_timestamp) AS session_timestamp,
           make_timestamp(earliest_event_timestamp)::DATE AS session_date,
           date_trunc('month', make_timestamp(earliest_event_timestamp))::DATE AS session_month,
           if(ga_session_number = 1, 'New', 'Returning') AS session_type
    FROM marketing WHERE ga_session_number >= 1
)"""

def users(bands=BANDS, horizons=HORIZONS) -> str:
    segment = " ".join(
        f"WHEN count(DISTINCT unique_session_id) >= {least} THEN '{label}'" for least, label in reversed(bands)
    )
    seen = ", ".join(
        f"""EXISTS (FROM visits v WHERE v.user_pseudo_id = c.user_pseudo_id
                   AND v.session_date = c.first_session_date + {n}) AS seen{n}"""
        for n in horizons
    )
    flags = ", ".join(
        f"(observed >= {n})::INT AS d{n}_eligible, (observed >= {n} AND seen{n})::INT AS d{n}_retained"
        for n in horizons
    )
    return f"""
purchasers AS (
    SELECT user_pseudo_id, count(DISTINCT unique_session_id) AS purchase_count,
           round(sum(session_revenue_usd::DECIMAL(18, 6)), 2)::DOUBLE AS total_revenue_usd,
           min(session_date) AS first_purchase_date, max(session_date) AS last_purchase_date,
           CASE {segment} END AS frequency_group
    FROM final WHERE purchase_flag = 1 GROUP BY user_pseudo_id
),
cohort AS (
    SELECT user_pseudo_id, session_date AS first_session_date,
           date_trunc('week', session_date)::DATE AS cohort_week,
           channel_group AS first_session_channel
    FROM final WHERE ga_session_number = 1
    QUALIFY row_number() OVER (PARTITION BY user_pseudo_id
                               ORDER BY session_timestamp, unique_session_id) = 1
),
visits AS (SELECT DISTINCT user_pseudo_id, session_date FROM final),
aged AS (
    SELECT c.*, (SELECT max(session_date) FROM final) - first_session_date AS observed, {seen}
    FROM cohort c
),
retained AS (
    SELECT user_pseudo_id, first_session_date, cohort_week, first_session_channel, {flags} FROM aged
)"""


def cohort_table(name: str, key: str, horizons=HORIZONS) -> str:
    """A cohort table as a common table expression: counts and rates per ``key``."""
    rates = ", ".join(
        f"((20000 * d{n}_retained_users + d{n}_eligible_users) // (2 * nullif(d{n}_eligible_users, 0)))::DOUBLE / 100"
        f" AS d{n}_retention_rate"
        for n in horizons
    )
    sums = ", ".join(
        f"sum(d{n}_{state})::BIGINT AS d{n}_{state}_users" for n in horizons for state in ("eligible", "retained")
    )
    return f"""
{name} AS (
    SELECT *, {rates}
    FROM (SELECT {key}, count(*) AS cohort_size, {sums} FROM retained GROUP BY ALL)
)"""


def prefix(own_domain=OWN_DOMAIN, mediums=MEDIUMS, stages=STAGES, bands=BANDS, horizons=HORIZONS) -> str:
    cohorts = ",".join(
        cohort_table(name, key, horizons)
        for name, key in (
            ("weekly", "cohort_week"),
            ("by_channel", "first_session_channel AS channel_group"),
            ("monthly", "date_trunc('month', first_session_date)::DATE AS cohort_month"),
        )
    )
    return f"WITH {EVENT_LOG},{sessions(own_domain, mediums, stages)},{users(bands, horizons)},{cohorts}\n"
