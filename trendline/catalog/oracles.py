"""The same queries as SQL for an independent engine."""

from __future__ import annotations

from trendline.catalog.inputs import BANDS, SEGMENT_NAMES
from trendline.functions.fixed_values import REGION_SHORT_NAMES

CUTOFF = "DATE '2001-07-03'"
SUMS = [band.sum for band in BANDS]
CUMULATIVE = [band.cumulative for band in BANDS]
AVERAGES = [band.average for band in BANDS]
CHANGES = [band.change for band in BANDS]


def _list(items) -> str:
    return ", ".join(items)


def _trend_steps(segment: str = "") -> str:
    """The steps of the trend table as named subqueries; ``segment`` is a key or empty."""
    key = f"{segment}, " if segment else ""
    part = f"PARTITION BY {segment} " if segment else ""
    using = f'USING ({key}"Date")'
    counts = _list(
        f"CAST(SUM(CASE WHEN age BETWEEN {b.low} AND {b.high} THEN 1 END) AS BIGINT) AS {b.sum}"
        for b in BANDS
    )
    running = _list(
        f"CAST(SUM({b.sum}) OVER ({part}ORDER BY d ROWS UNBOUNDED PRECEDING) AS BIGINT)"
        f" AS {b.cumulative}"
        for b in BANDS
    )
    filled = _list(
        f"COALESCE(LAST_VALUE(NULLIF({b.cumulative}, 0) IGNORE NULLS) OVER"
        f' ({part}ORDER BY "Date" ROWS UNBOUNDED PRECEDING), 0) AS {b.cumulative}'
        for b in BANDS
    )
    averages = _list(
        f"ROUND(COALESCE({b.cumulative} - LAG({b.cumulative}, 7) OVER"
        f' ({part}ORDER BY "Date"), 0) / 7, 1) AS {b.average}'
        for b in BANDS
    )
    tracked = _list(
        f"LAST_VALUE(NULLIF({b.average}, 0) IGNORE NULLS) OVER"
        f' ({part}ORDER BY "Date" ROWS UNBOUNDED PRECEDING) AS {b.average}'
        for b in BANDS
    )
    changes = _list(
        f"COALESCE({b.average} - LAG({b.average}, {b.change_rows}) OVER"
        f' ({part}ORDER BY "Date"), 0) AS {b.change}'
        for b in BANDS
    )
    return f"""
WITH raw AS (
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS event_date,
         CAST(o_orderdate AS DATE) AS reported_date, l_returnflag AS outcome,
         CAST(l_quantity AS INTEGER) AS age, o_orderpriority AS segment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cases AS (
  SELECT * FROM (
    SELECT CASE WHEN event_date IS NULL OR event_date < DATE '1996-01-01'
                THEN reported_date ELSE event_date END AS event_date, age, segment
    FROM raw WHERE outcome LIKE '%R%') repaired
  WHERE event_date < {CUTOFF}),
daily AS (SELECT {key}event_date AS d, {counts} FROM cases GROUP BY ALL),
cumulative AS (SELECT {key}d AS "Date", {_list(SUMS)}, {running} FROM daily),
spine AS (SELECT DISTINCT {key}event_date AS "Date" FROM raw WHERE event_date IS NOT NULL),
complete AS (
  SELECT {key}"Date", {_list(f"COALESCE({c}, 0) AS {c}" for c in SUMS + CUMULATIVE)}
  FROM cumulative FULL JOIN spine {using}),
filled AS (SELECT {key}"Date", {_list(SUMS)}, {filled} FROM complete),
averages AS (SELECT *, {averages} FROM filled),
reported AS (
  SELECT DISTINCT {key}reported_date AS "Date" FROM raw WHERE reported_date < {CUTOFF}),
tracked AS (
  SELECT {key}"Date", present, {tracked}
  FROM reported LEFT JOIN (SELECT *, TRUE AS present FROM averages) a {using}),
changed AS (SELECT {key}"Date", present, {changes} FROM tracked),
changes AS (SELECT {key}"Date", {_list(CHANGES)} FROM changed WHERE present)
"""


TREND = _trend_steps()
TREND_BY_SEGMENT = _trend_steps("segment")


def _tracker(segment: str = "", source: str = "orders") -> str:
    key = f"{segment}, " if segment else ""
    part = f"PARTITION BY {segment} " if segment else ""
    span = f'({part}ORDER BY "Date" ROWS UNBOUNDED PRECEDING)'
    return f"""
WITH daily AS (
  SELECT {key}CAST(o_orderdate AS DATE) AS "Date", COUNT(*) AS n,
         COUNT(*) FILTER (o_orderstatus = 'F') AS f, COUNT(*) FILTER (o_orderstatus = 'O') AS o,
         COUNT(*) FILTER (o_orderstatus = 'P') AS p
  FROM {source} GROUP BY ALL),
tracker AS (
  SELECT {key}"Date", n AS daily_dose_count_total,
         AVG(n) OVER ({part}ORDER BY "Date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
           AS "doses_administered_7-day_avg",
         CAST(SUM(f) OVER {span} AS BIGINT) AS "people_w/_at_least_one_dose",
         CAST(SUM(o) OVER {span} AS BIGINT) AS people_fully_vaccinated,
         CAST(SUM(p) OVER {span} AS BIGINT) AS "people_w/_fall_booster"
  FROM daily),
ranked AS (
  SELECT *, ROW_NUMBER() OVER ({part}ORDER BY "Date" DESC) AS place FROM tracker)
"""


TRACKER = _tracker()


def _figures(segment: str = "", date_name: str = "date") -> str:
    def latest(metric):
        return f'MAX("{metric}") FILTER (place = 1)'

    def recent(function, metric):
        return f'{function}("{metric}") FILTER (place <= 8)'

    daily, average = "daily_dose_count_total", "doses_administered_7-day_avg"
    first, full = "people_w/_at_least_one_dose", "people_fully_vaccinated"
    booster = "people_w/_fall_booster"
    key = f"{segment}, " if segment else ""
    group = f"GROUP BY {segment}" if segment else ""
    return f"""
SELECT {key}MAX("Date") AS "{date_name}",
       CAST(SUM({daily}) AS BIGINT) AS cumulative_doses,
       CAST(SUM({daily}) FILTER (place <= 7) AS BIGINT) AS dailydose_count_total,
       {latest(daily)} AS daily_doses_lastdate,
       {latest(daily)} - {recent("MAX", daily)} AS daily_dose_diff_,
       {latest(average)} AS doses_administered_7dayavg,
       {latest(average)} - {recent("MAX", average)} AS daily_dose_diff,
       {latest(first)} AS people_least1dose,
       {latest(first)} - {recent("MIN", first)} AS "7day_rolling_min1dose",
       {latest(full)} AS p_fully_vaccinated,
       {latest(full)} - {recent("MIN", full)} AS "7day_fullvac",
       {latest(booster)} AS people_fall_booster,
       {latest(booster)} - {recent("MIN", booster)} AS "spring/fall_booster_7dayroll"
FROM ranked {group}
"""


DAY = "CAST(o_orderdate AS DATE)"
WEEK = f"'Week' || LPAD(CAST(WEEKOFYEAR({DAY}) AS VARCHAR), 2, '0')"

DATE_LABELS = f"""
WITH labels AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 2 = 0 THEN STRFTIME({DAY}, '%Y %b%d %Y')
              ELSE STRFTIME({DAY}, '%Y ') || {WEEK} || STRFTIME({DAY}, ' %b%d') END AS label
  FROM orders)
"""

TURNS = """
WITH turns AS (
  SELECT conv_id, turn, '### ' || COALESCE(role, '') || ': ' || COALESCE(text, '') AS piece
  FROM conversations)
"""

TRUNCATED = f"""{TURNS},
words AS (
  SELECT conv_id, LIST_FILTER(STRING_SPLIT_REGEX(STRING_AGG(piece, ' ' ORDER BY turn), '\\s+'),
                              LAMBDA w : w <> '') AS w
  FROM turns GROUP BY conv_id),
truncated AS (
  SELECT conv_id, CAST(LEAST(LEN(w), 512) AS BIGINT) AS n_tokens,
         ARRAY_TO_STRING(w[1:512], ' ') AS text
  FROM words)
"""

PAGE_ROWS = """
SELECT page_id, CAST(place - 1 AS INTEGER) AS row_idx,
       REGEXP_EXTRACT(item, 'href="([^"]*)"', 1) AS c0, REGEXP_EXTRACT(item, '>([^<]*)<', 1) AS c1
FROM (SELECT page_id, UNNEST(items) AS item, GENERATE_SUBSCRIPTS(items, 1) AS place
      FROM (SELECT page_id,
                   REGEXP_EXTRACT_ALL(html, '<li>(<a href="[^"]*">[^<]*</a>)</li>', 1) AS items
            FROM pages) found) cut
"""

PARTIES = "SELECT c_custkey AS key, c_name AS name, {0} FROM customer"

# Line items of which only equal ones share their order.
ITEM_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_discount, quantity"
ITEM_ORDER = f"ORDER BY {ITEM_COLUMNS}"
ITEMS = f"(SELECT {ITEM_COLUMNS.replace('quantity', 'CAST(l_quantity AS BIGINT) AS quantity')} FROM lineitem)"

ORACLES: dict[str, str] = {
    "linelist_clean": f"{TREND} SELECT event_date, age FROM cases",
    "band_daily_counts": f'{TREND} SELECT d AS "Date", {_list(SUMS)} FROM daily',
    "band_cumulative": f"{TREND} SELECT * FROM cumulative",
    "band_cumulative_by_segment": f"{TREND_BY_SEGMENT} SELECT * FROM cumulative",
    "date_spine": f"{TREND} SELECT * FROM spine",
    "spine_ffill": f"{TREND} SELECT * FROM filled",
    "band_avg7": f"{TREND} SELECT * FROM averages",
    "reported_spine_diff": f"{TREND} SELECT * FROM changes",
    "band_trend": f'{TREND} SELECT * FROM averages LEFT JOIN changes USING ("Date")',
    "band_trend_by_segment": (
        f'{TREND_BY_SEGMENT} SELECT * FROM averages LEFT JOIN changes USING (segment, "Date")'
    ),
    "weekly_cutoff": f"""
        SELECT day, CAST(day - CAST((ISODOW(day) + 5) % 7 AS INTEGER) AS DATE) AS cutoff
        FROM (SELECT DISTINCT {DAY} AS day FROM orders WHERE o_orderdate IS NOT NULL) days""",
    "fill_numeric_nulls": f"""
        SELECT c_custkey, c_name, COALESCE(n, 0) AS n_orders, last_order
        FROM customer LEFT JOIN
          (SELECT o_custkey, COUNT(*) AS n, MAX({DAY}) AS last_order FROM orders GROUP BY 1) counts
          ON c_custkey = o_custkey""",
    "sorted_columns": (
        "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer"
    ),
    "cumulative_two_phase": """
        SELECT o_orderkey, SUM(CAST(o_totalprice AS DECIMAL(18, 2)))
          OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS running_total
        FROM orders""",
    "row_index": """
        SELECT o_orderdate, o_orderkey,
               ROW_NUMBER() OVER (ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS id
        FROM orders""",
    "ffill_ordered": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, quantity,
               LAST_VALUE(NULLIF(l_discount, 0) IGNORE NULLS) OVER (
                 {ITEM_ORDER} ROWS UNBOUNDED PRECEDING) AS l_discount
        FROM {ITEMS}""",
    "back_fill_ordered": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, quantity,
               FIRST_VALUE(NULLIF(l_discount, 0) IGNORE NULLS) OVER (
                 {ITEM_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l_discount
        FROM {ITEMS}""",
    "lag_ordered": f"""
        SELECT *, COALESCE(quantity - LAG(quantity, 7) OVER ({ITEM_ORDER}), 0) AS change
        FROM {ITEMS}""",
    "zip_by_position": """
        SELECT * FROM
          (SELECT c_custkey, c_name, ROW_NUMBER() OVER (ORDER BY c_custkey) AS id FROM customer) c
        JOIN
          (SELECT s_suppkey, s_name, ROW_NUMBER() OVER (ORDER BY s_suppkey) AS id FROM supplier) s
        USING (id)""",
    "metric_total": f"""{TRACKER}
        SELECT CAST(SUM(daily_dose_count_total) AS BIGINT) AS total FROM tracker""",
    "last7_sum": f"""{TRACKER}
        SELECT CAST(SUM(daily_dose_count_total) AS BIGINT) AS last7 FROM ranked WHERE place <= 7""",
    "latest_value": f"""{TRACKER}
        SELECT ARG_MAX_NULL(daily_dose_count_total, "Date") AS latest FROM tracker""",
    "top_k_latest": f"""{TRACKER}
        SELECT daily_dose_count_total FROM ranked WHERE place <= 8""",
    "latest_minus_max8": f"""{TRACKER}
        SELECT MAX("Date") AS "Date", COALESCE(MAX(daily_dose_count_total) FILTER (place = 1), 0)
               - MAX(daily_dose_count_total) AS diff
        FROM ranked WHERE place <= 8""",
    "latest_minus_min8": f"""{TRACKER}
        SELECT MAX("Date") AS "Date", MAX("people_w/_at_least_one_dose") FILTER (place = 1)
               - MIN("people_w/_at_least_one_dose") AS diff
        FROM ranked WHERE place <= 8""",
    "scalar_cross_join": f"""{TRACKER}
        SELECT CAST(SUM(daily_dose_count_total) AS BIGINT) AS total,
               CAST(SUM(daily_dose_count_total) FILTER (place <= 7) AS BIGINT) AS last7,
               MAX(daily_dose_count_total) FILTER (place = 1) AS latest
        FROM ranked""",
    "kpi_row": f"{TRACKER} {_figures()}",
    "kpi_by_segment": _tracker(
        "nation",
        "(SELECT c_nationkey AS nation, o_orderdate, o_orderstatus"
        " FROM orders JOIN customer ON o_custkey = c_custkey) by_nation",
    )
    + _figures("nation"),
    "kpi_attach": f"""{TRACKER},
        figures AS ({_figures(date_name="Date")})
        SELECT * FROM tracker FULL JOIN figures USING ("Date")""",
    "week_label_to_date": f"""
        SELECT o_orderkey,
               STRFTIME({DAY}, '%Y ')
               || CASE WHEN o_orderkey % 5 = 0 THEN '20' ELSE {WEEK} END
               || STRFTIME({DAY}, ' %b%d')
               || CASE WHEN o_orderkey % 2 = 0 THEN STRFTIME({DAY}, ' %Y') ELSE '' END AS week,
               CASE WHEN o_orderkey % 5 <> 0 THEN {DAY} END AS "Transformed_Date"
        FROM orders""",
    "compact_date_fix": f"""{DATE_LABELS}
        SELECT o_orderkey, label,
               CASE WHEN o_orderkey % 2 = 0 THEN LOWER(STRFTIME({DAY}, '%Y%b%d'))
                    ELSE label END AS fixed
        FROM labels JOIN orders USING (o_orderkey)""",
    "strip_week_token": f"""{DATE_LABELS}
        SELECT o_orderkey, label,
               REGEXP_REPLACE(LOWER(REPLACE(label, ' ', '')), 'week[0-9][0-9]', '', 'g') AS stripped
        FROM labels""",
    "band_label": """
        SELECT p_partkey, label AS age_group_new,
               CAST(TIMESTAMP '2023-01-01 06:30:00' + TO_DAYS(p_size + 1) AS DATE)
                 AS "current_date:",
               CAST(TIMESTAMP '2023-01-01 06:30:00' + TO_DAYS(p_size) AS DATE) AS "yesterday_date:",
               REPLACE(label, 'to', '-') AS age_group,
               ROW_NUMBER() OVER (ORDER BY p_partkey) AS id
        FROM (SELECT p_partkey, p_size,
                     CASE WHEN p_size >= 50 THEN '50+'
                          ELSE CAST((p_size - 1) // 10 * 10 + 1 AS VARCHAR) || 'to'
                               || CAST((p_size - 1) // 10 * 10 + 10 AS VARCHAR) END AS label
              FROM part) labelled""",
    "rename_lookup": f"""
        SELECT c_mktsegment AS public_health_unit, c_custkey, short AS "new_PHUnames"
        FROM customer JOIN (VALUES {_list(f"('{k}', '{v}')" for k, v in SEGMENT_NAMES.items())})
          lookup(segment, short) ON c_mktsegment = segment""",
    "rename_by_position": f"""
        SELECT c_nationkey, customers, short AS "new_PHUnames"
        FROM (SELECT c_nationkey, COUNT(*) AS customers,
                     ROW_NUMBER() OVER (ORDER BY c_nationkey NULLS FIRST) AS place
              FROM customer GROUP BY c_nationkey) units
        JOIN (VALUES {_list(f"({n}, '{v}')" for n, v in enumerate(REGION_SHORT_NAMES, 1))})
          names(position, short) ON place = position""",
    "timestamp_to_date": "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1",
    "safe_column_names": """
        SELECT s_suppkey AS supplier_key, s_name AS name__full_,
               s_nationkey AS "people_w/_nation", s_acctbal AS "people_w/_nation_2"
        FROM supplier""",
    "union_by_name": f"""{PARTIES.format("c_mktsegment AS segment")}
        UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
    "union_positional": """
        SELECT c_custkey AS key, c_name AS name FROM customer
        UNION ALL SELECT s_suppkey, s_name FROM supplier""",
    "back_fill": f"""{TRACKER},
        patchy AS (SELECT "Date", CASE WHEN DAYOFYEAR("Date") % 3 <> 0
                                       THEN daily_dose_count_total END AS doses FROM tracker)
        SELECT "Date", FIRST_VALUE(doses IGNORE NULLS) OVER
          (ORDER BY "Date" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS doses
        FROM patchy""",
    "drop_footer": """
        SELECT o_orderkey AS row_idx, o_totalprice FROM orders
        WHERE o_orderkey < (SELECT MAX(o_orderkey) FROM orders)""",
    "drop_footer_by_sheet": """
        SELECT o_custkey AS sheet, o_orderkey AS row_idx, o_totalprice
        FROM (SELECT *, MAX(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders) sheets
        WHERE o_orderkey < last""",
    "corpus_split_stored": "SELECT doc_id, text FROM documents WHERE lang = 'en'",
    "corpus_split": "SELECT doc_id, text FROM documents WHERE lang = 'en'",
    "sft_text": f"""{TURNS}
        SELECT conv_id, COUNT(*) AS n_turns, STRING_AGG(piece, CHR(10) ORDER BY turn) AS text
        FROM turns GROUP BY 1""",
    "sft_truncate": f"{TRUNCATED} SELECT * FROM truncated",
    "sft_length_batches": f"""{TRUNCATED},
        grouped AS (SELECT conv_id, n_tokens,
                           (ROW_NUMBER() OVER (ORDER BY conv_id) - 1) // 200 AS g FROM truncated),
        placed AS (SELECT conv_id, n_tokens, g * 50 + (ROW_NUMBER() OVER
                     (PARTITION BY g ORDER BY n_tokens DESC, conv_id) - 1) // 4 AS batch
                   FROM grouped)
        SELECT conv_id, n_tokens, CAST(batch AS BIGINT) AS batch,
               CAST(batch // 4 AS BIGINT) AS step
        FROM placed""",
    "page_rows": PAGE_ROWS,
    "page_rows_csv": PAGE_ROWS,
    "page_assets": """
        SELECT page_id, tag,
               CAST(LEN(REGEXP_EXTRACT_ALL(html, '(?i)<' || tag || '[\\s/>]')) AS BIGINT) AS n
        FROM pages, (VALUES ('a'), ('script'), ('style'), ('div')) tags(tag)
        WHERE REGEXP_MATCHES(html, '(?i)<' || tag || '[\\s/>]')""",
    "page_grid": """
        WITH found AS (
          SELECT page_id, REGEXP_EXTRACT_ALL(html, '<li>(<a href="[^"]*">[^<]*</a>)</li>', 1) AS items
          FROM pages WHERE html LIKE '%<ul>%')
        SELECT page_id, CAST(0 AS INTEGER) AS table_idx, CAST(0 AS INTEGER) AS row_idx,
               CAST(3 AS INTEGER) AS width, 'links' AS c0, 'target' AS c1, 'target' AS c2
        FROM found
        UNION ALL
        SELECT page_id, 0, CAST(place AS INTEGER), 3, 'links',
               REGEXP_EXTRACT(item, '>([^<]*)<', 1), REGEXP_EXTRACT(item, 'href="([^"]*)"', 1)
        FROM (SELECT page_id, UNNEST(items) AS item, GENERATE_SUBSCRIPTS(items, 1) AS place
              FROM found) cut""",
    "page_asset_list": """
        WITH bare AS (
          SELECT page_id, REGEXP_REPLACE(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>'
                   || '|<title>.*?</title>', '', 'g') AS html
          FROM pages),
        found AS (
          SELECT page_id, REGEXP_EXTRACT_ALL(html, '<a href="([^"]*)"', 1) AS links FROM bare)
        SELECT page_id, CAST(UNNEST(RANGE(LEN(links))) AS INTEGER) AS asset_idx, 'a' AS tag,
               UNNEST(links) AS href, CAST(NULL AS VARCHAR) AS title
        FROM found""",
    "label_functions_in_sql": f"""{DATE_LABELS}
        SELECT o_orderkey, label,
               CASE WHEN o_orderkey % 2 = 0 THEN LOWER(STRFTIME({DAY}, '%Y%b%d'))
                    ELSE label END AS fixed,
               REGEXP_REPLACE(LOWER(REPLACE(label, ' ', '')), 'week[0-9][0-9]', '', 'g') AS stripped,
               o_orderkey || '-' || (o_orderkey + 9) AS keys
        FROM labels JOIN orders USING (o_orderkey)""",
    "read_csv_typed": "SELECT * FROM customer",
    "read_csv_inferred": "SELECT * REPLACE (CAST(c_custkey AS INTEGER) AS c_custkey) FROM customer",
    "read_zipped_csv": f"""
        SELECT o_orderkey, o_totalprice, o_orderpriority, {DAY} AS day FROM orders""",
    "read_zipped_csv_source": f"SELECT {DAY} AS day, o_orderkey FROM orders",
    "read_zipped_csv_inferred": f"""
        SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_totalprice, o_orderpriority, {DAY} AS day
        FROM orders""",
    "read_workbooks": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
    "read_workbooks_source": """
        SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size,
               CAST(p_retailprice AS VARCHAR) AS p_retailprice
        FROM part""",
    "read_workbooks_inferred": """
        SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_size, p_retailprice FROM part""",
    "replace_table": "SELECT * FROM customer",
    "sql_view_scan": "SELECT * FROM customer",
    "sql_view_filter": (
        "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000"
    ),
}
