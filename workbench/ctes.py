"""The same tables and intermediate results as named SQL queries, each with the names it reads."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

DAY = "scheduled_departure_date_local"
DEST = "scheduled_arrival_station_code"

# Written out here, not imported, so that a wrong value in the package shows.
DEFAULT_WEIGHTS = {
    "ground_time_pressure": 0.15, "actual_turn_deficit": 0.07, "turn_deficit_ratio": 0.05, "total_bags": 0.06, "transfer_ratio": 0.06,
    "hot_transfer_count": 0.04, "total_pax": 0.08, "load_factor": 0.06, "basic_economy_ratio": 0.05, "booking_lead_days_mean": 0.04,
    "late_booking_ratio": 0.04, "children": 0.04, "lap_children": 0.03, "stroller_users": 0.03, "ssr_count": 0.10, "is_international": 0.04,
    "widebody_flag": 0.06,
}
FULL_WEIGHTS = {
    "ground_time_pressure": 0.13, "actual_turn_deficit": 0.06, "turn_deficit_ratio": 0.05, "total_bags": 0.05, "transfer_ratio": 0.05,
    "hot_transfer_count": 0.03, "total_pax": 0.07, "load_factor": 0.05, "basic_economy_ratio": 0.04, "booking_lead_days_mean": 0.04,
    "late_booking_ratio": 0.04, "children": 0.03, "lap_children": 0.02, "stroller_users": 0.02, "ssr_count": 0.08, "is_international": 0.04,
    "widebody_flag": 0.05, "ssr_mobility_count": 0.02, "ssr_special_handling_count": 0.02, "bag_issue_lead_mean": 0.02,
    "bag_late_issue_ratio": 0.02, "bag_per_seat_ratio": 0.02, "destination_base_difficulty": 0.02, "load_factor_volatility": 0.015,
    "ground_time_pressure_volatility": 0.015, "slot_congestion_count": 0.015, "transfer_ground_interaction": 0.015,
    "load_pressure_interaction": 0.015, "weather_severity_index": 0.01,
}

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: Sequence[str], sql: str) -> None:
    CTES[name] = (list(needs), sql)


def with_ctes(names: Sequence[str], select: str) -> str:
    """The select, headed by the named queries and all that they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for needed in CTES[name][0]:
                visit(needed)
            order.append(name)

    for name in names:
        visit(name)
    heads = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    return f"WITH {heads}\n{select}" if heads else select


def number(value: float) -> str:
    """A double literal; plain digits would be read as a decimal."""
    return f"CAST('{value!r}' AS DOUBLE)"


FLIGHT_COLUMNS = f"""
    o_orderkey AS flight_id, o_custkey AS flight_number, CAST(o_orderdate AS DATE) AS {DAY},
    'S' || CAST(o_custkey % 40 AS VARCHAR) AS scheduled_departure_station_code, n_name AS {DEST},
    o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS scheduled_departure_datetime_local,
    o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) + to_minutes(60 + o_orderkey % 420)
        AS scheduled_arrival_datetime_local,
    CASE WHEN o_custkey % 97 = 0 THEN 0 ELSE 50 + o_custkey % 250 END AS total_seats,
    CASE o_orderkey % 5 WHEN 0 THEN '738' WHEN 1 THEN '767-300' WHEN 2 THEN 'A330' WHEN 3 THEN 'E175' ELSE '777' END AS fleet_type,
    CASE WHEN o_orderstatus = 'P' THEN 'Express' ELSE 'Mainline' END AS carrier,
    20 + o_orderkey % 90 AS scheduled_ground_time_minutes, 15 + (o_orderkey * 13) % 100 AS actual_ground_time_minutes,
    30 + o_custkey % 40 AS minimum_turn_minutes"""
FLIGHT_SOURCE = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

cte("flights", [], f"SELECT {FLIGHT_COLUMNS} FROM {FLIGHT_SOURCE}")
cte(
    "late_flights",
    [],
    f"""SELECT {FLIGHT_COLUMNS},
    o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60)
        + to_minutes((o_orderkey * 37) % 61 - 20 + 2 * coalesce(lines, 0)) AS actual_departure_datetime_local
    FROM {FLIGHT_SOURCE} LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
cte(
    "bags",
    [],
    """SELECT l_orderkey AS flight_id, CASE l_returnflag WHEN 'N' THEN 'Checked' WHEN 'A' THEN 'Transfer' ELSE 'Hot Transfer' END
    AS bag_type, l_shipdate AS bag_tag_issue_datetime FROM lineitem""",
)
cte(
    "bookings",
    [],
    f"""SELECT l_orderkey AS flight_id, l_partkey AS record_locator, l_shipdate AS pnr_creation_date,
    CAST(l_quantity AS BIGINT) AS total_pax, CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS is_child,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS is_stroller_user,
    l_linenumber % 3 AS lap_child_count,
    CASE WHEN l_discount >= 0.05 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS basic_economy_pax,
    CAST(o_orderdate AS DATE) AS {DAY},
    CAST(floor((epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) - epoch_us(l_shipdate)) / 86400000000.0) AS BIGINT)
        AS booking_lead_days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
cte(
    "remarks",
    [],
    "SELECT p_partkey - p_partkey % 2 AS record_locator, p_name || ' ' || p_type AS special_service_request FROM part",
)
cte(
    "airports",
    [],
    "SELECT DISTINCT n_name AS airport_iata_code, r_name AS iso_country_code FROM nation JOIN region ON n_regionkey = r_regionkey",
)
cte(
    "event_flights",
    [],
    """SELECT event_id AS flight_id, 'S' || CAST(user_id % 10 AS VARCHAR) AS scheduled_departure_station_code,
    ts AS scheduled_departure_datetime_local FROM events""",
)
cte(
    "hourly_weather",
    [],
    """SELECT 'S' || CAST(user_id % 10 AS VARCHAR) AS station_code, date_trunc('hour', ts) AS weather_hour,
    avg(value) AS weather_severity_index FROM events GROUP BY 1, 2""",
)
cte(
    "passengers",
    ["bookings"],
    """SELECT flight_id, CAST(sum(total_pax) AS BIGINT) AS total_pax, CAST(sum(basic_economy_pax) AS BIGINT) AS basic_economy_pax,
    count(*) FILTER (WHERE is_child = 'Y') AS children, count(*) FILTER (WHERE is_stroller_user = 'Y') AS stroller_users,
    CAST(sum(lap_child_count) AS BIGINT) AS lap_children, avg(booking_lead_days) AS booking_lead_days_mean,
    median(booking_lead_days) AS booking_lead_days_median,
    avg(CASE WHEN booking_lead_days <= 3 THEN 1.0 ELSE 0.0 END) AS late_booking_ratio
    FROM bookings GROUP BY flight_id""",
)
cte(
    "type_counts",
    ["bags"],
    """SELECT flight_id, count(*) FILTER (WHERE bag_type = 'Checked') AS checked_bags,
    count(*) FILTER (WHERE bag_type = 'Transfer') AS transfer_bags,
    count(*) FILTER (WHERE bag_type = 'Hot Transfer') AS hot_transfer_count FROM bags GROUP BY flight_id""",
)
cte(
    "bag_counts",
    ["type_counts"],
    """SELECT flight_id, checked_bags, hot_transfer_count, transfer_bags + hot_transfer_count AS total_transfer_bags,
    checked_bags + transfer_bags + hot_transfer_count AS total_bags,
    (transfer_bags + hot_transfer_count) / nullif(CAST(checked_bags + transfer_bags + hot_transfer_count AS DOUBLE), 0)
        AS transfer_ratio FROM type_counts""",
)
cte(
    "bag_shares",
    ["type_counts"],
    """SELECT flight_id, checked_bags, transfer_bags, checked_bags + transfer_bags AS total_bags,
    transfer_bags / nullif(CAST(checked_bags + transfer_bags AS DOUBLE), 0) AS transfer_ratio FROM type_counts""",
)
cte(
    "bag_timing",
    ["bags", "flights"],
    """SELECT flight_id, avg(lead) AS bag_issue_lead_mean, avg(CASE WHEN lead <= 0 THEN 1.0 ELSE 0.0 END) AS bag_late_issue_ratio
    FROM (SELECT b.flight_id, (epoch_us(scheduled_departure_datetime_local) - epoch_us(bag_tag_issue_datetime)) / 86400000000.0 AS lead
          FROM bags b LEFT JOIN (SELECT DISTINCT flight_id, scheduled_departure_datetime_local FROM flights) f
          ON b.flight_id = f.flight_id) GROUP BY flight_id""",
)
cte("pairs", [], "SELECT DISTINCT l_orderkey AS flight_id, l_partkey AS record_locator FROM lineitem")


def any_word(words: Sequence[str]) -> str:
    return " OR ".join(f"contains(upper(special_service_request), '{word}')" for word in words)


cte(
    "requests",
    ["pairs", "remarks"],
    f"""SELECT flight_id, count(*) AS ssr_count, count(*) FILTER (WHERE {any_word(['HOT', 'RED'])}) AS ssr_mobility_count,
    count(*) FILTER (WHERE {any_word(['PROMO'])}) AS ssr_special_handling_count
    FROM pairs JOIN remarks USING (record_locator) GROUP BY flight_id""",
)
cte(
    "fanout_requests",
    ["pairs", "remarks"],
    """SELECT flight_id, CAST(sum(n) AS BIGINT) AS ssr_count FROM pairs JOIN
    (SELECT record_locator, count(*) AS n FROM pairs JOIN remarks USING (record_locator) GROUP BY 1) USING (record_locator)
    GROUP BY flight_id""",
)
TURN = """greatest(minimum_turn_minutes - scheduled_ground_time_minutes, 0) AS ground_time_pressure,
    greatest(minimum_turn_minutes - actual_ground_time_minutes, 0) AS actual_turn_deficit,
    actual_ground_time_minutes / CAST(minimum_turn_minutes AS DOUBLE) AS turn_deficit_ratio"""
WIDE = "CASE WHEN total_seats >= 250 OR regexp_matches(fleet_type, '767|777|787|330|350') THEN 1 ELSE 0 END AS widebody_flag"
SEATS = "nullif(CAST(total_seats AS DOUBLE), 0)"


def master_sql(source: str) -> str:
    return f"""SELECT f.*, coalesce(p.total_pax, 0) AS total_pax, coalesce(children, 0) AS children,
    coalesce(stroller_users, 0) AS stroller_users, coalesce(lap_children, 0) AS lap_children, booking_lead_days_mean,
    late_booking_ratio, coalesce(p.total_pax, 0) / {SEATS} AS load_factor,
    coalesce(basic_economy_pax / nullif(CAST(p.total_pax AS DOUBLE), 0), 0) AS basic_economy_ratio,
    coalesce(hot_transfer_count, 0) AS hot_transfer_count, coalesce(total_transfer_bags, 0) AS total_transfer_bags,
    coalesce(total_bags, 0) AS total_bags, coalesce(transfer_ratio, 0) AS transfer_ratio,
    coalesce(ssr_count, 0) AS ssr_count, coalesce(ssr_mobility_count, 0) AS ssr_mobility_count,
    coalesce(ssr_special_handling_count, 0) AS ssr_special_handling_count,
    CASE WHEN iso_country_code = 'AMERICA' THEN 0 ELSE 1 END AS is_international, {TURN}, {WIDE}
    FROM {source} f LEFT JOIN passengers p USING (flight_id) LEFT JOIN bag_counts USING (flight_id) LEFT JOIN requests USING (flight_id)
    LEFT JOIN airports ON {DEST} = airport_iata_code"""


MASTER_NEEDS = ["passengers", "bag_counts", "requests", "airports"]
cte("master", ["flights", *MASTER_NEEDS], master_sql("flights"))
cte("late_master", ["late_flights", *MASTER_NEEDS], master_sql("late_flights"))
cte("slice", ["master"], "SELECT * FROM master")
cte(
    "flight_weather",
    [],
    """SELECT 'S' || CAST(user_id % 40 AS VARCHAR) AS station_code,
    date_trunc('hour', TIMESTAMP '1995-01-01' + to_hours(CAST(event_id * 37 % 60000 AS INTEGER)) + to_minutes(CAST(event_id % 60 AS INTEGER))) AS weather_hour,
    avg(value) AS severity FROM events GROUP BY 1, 2""",
)


def deviation(name: str) -> str:
    frame = f"OVER (PARTITION BY flight_number ORDER BY {DAY}, flight_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    return f"coalesce(CASE WHEN count({name}) {frame} >= 2 THEN stddev_samp({name}) {frame} END, 0) AS {name}_volatility"


SLOTS = "count(*) OVER (PARTITION BY scheduled_departure_station_code, hour(scheduled_departure_datetime_local)) AS slot_congestion_count"
cte(
    "full_master",
    ["master", "bag_timing", "flight_weather"],
    f"""SELECT m.*, coalesce(bag_issue_lead_mean, 0) AS bag_issue_lead_mean, coalesce(bag_late_issue_ratio, 0) AS bag_late_issue_ratio,
    coalesce(total_bags / {SEATS}, 0) AS bag_per_seat_ratio, {SLOTS}, {deviation('load_factor')}, {deviation('ground_time_pressure')},
    transfer_ratio * ground_time_pressure AS transfer_ground_interaction,
    load_factor * ground_time_pressure AS load_pressure_interaction, coalesce(severity, 0) AS weather_severity_index
    FROM master m LEFT JOIN bag_timing USING (flight_id) LEFT JOIN flight_weather w ON w.station_code = scheduled_departure_station_code
    AND w.weather_hour = date_trunc('hour', scheduled_departure_datetime_local)""",
)


def scaled_sql(source: str, features: Sequence[str]) -> str:
    columns = []
    for name in features:
        low, high = (f"{end}(CAST({name} AS DOUBLE)) OVER (PARTITION BY {DAY})" for end in ("min", "max"))
        columns.append(f"coalesce((CAST({name} AS DOUBLE) - {low}) / nullif({high} - {low}, 0), 0) AS {name}_scaled")
    return f"SELECT *, {', '.join(columns)} FROM {source}"


def scored_sql(source: str, features: Sequence[str], weights: Mapping[str, float]) -> str:
    total_weight = math.fsum(weights.values())
    shares = {name: weight / total_weight for name, weight in weights.items()}
    total = " + ".join(["CAST(0 AS DOUBLE)", *[f"{name}_scaled * {number(shares[name])}" for name in features]])
    share = f"(daily_rank - 1) / CAST(greatest(count(*) OVER (PARTITION BY {DAY}) - 1, 1) AS DOUBLE)"
    return f"""SELECT *, CASE WHEN {share} < 0.25 THEN 'Difficult' WHEN {share} < 0.75 THEN 'Medium' ELSE 'Easy' END AS difficulty_class
    FROM (SELECT *, dense_rank() OVER (PARTITION BY {DAY} ORDER BY difficulty_score DESC) AS daily_rank
          FROM (SELECT *, CAST(round(({total}) * CAST(1000000000 AS DOUBLE)) AS BIGINT) / CAST(1000000000 AS DOUBLE) AS difficulty_score
                FROM {source}))"""


DEFAULTS = SLICE = list(DEFAULT_WEIGHTS)
FIRST = [name for name in FULL_WEIGHTS if name != "destination_base_difficulty"]
cte("slice_scaled", ["slice"], scaled_sql("slice", SLICE))
cte("slice_scored", ["slice_scaled"], scored_sql("slice_scaled", SLICE, DEFAULT_WEIGHTS))
cte("scaled", ["master"], scaled_sql("master", DEFAULTS))
cte("scored", ["scaled"], scored_sql("scaled", DEFAULTS, DEFAULT_WEIGHTS))
cte("late_scaled", ["late_master"], scaled_sql("late_master", DEFAULTS))
cte("first_scaled", ["full_master"], scaled_sql("full_master", FIRST))
cte("first_scored", ["first_scaled"], scored_sql("first_scaled", FIRST, FULL_WEIGHTS))


def daily_sql(source: str) -> str:
    return f"""SELECT {DEST}, {DAY}, count(difficulty_class) AS flights,
    count(*) FILTER (WHERE difficulty_class = 'Difficult') AS difficult FROM {source} GROUP BY 1, 2"""


def baseline_sql(source: str, frame: str) -> str:
    over = f"OVER (PARTITION BY {DEST} ORDER BY {frame})"
    return f"""SELECT *, CASE WHEN sum(flights) {over} >= 5 THEN sum(difficult) {over} / CAST(sum(flights) {over} AS DOUBLE) END
    AS destination_base_difficulty FROM {source}"""


ROW_FRAME = f"{DAY} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING"
CALENDAR_FRAME = f"datediff('day', DATE '1970-01-01', {DAY}) RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING"
cte("slice_daily", ["slice_scored"], daily_sql("slice_scored"))
cte("slice_baseline", ["slice_daily"], baseline_sql("slice_daily", ROW_FRAME))
cte("slice_calendar", ["slice_daily"], baseline_sql("slice_daily", CALENDAR_FRAME))
cte("first_daily", ["first_scored"], daily_sql("first_scored"))
cte("first_baseline", ["first_daily"], baseline_sql("first_daily", ROW_FRAME))
cte(
    "second_master",
    ["first_scaled", "first_baseline"],
    f"""SELECT s.*, coalesce(b.destination_base_difficulty, 0) AS destination_base_difficulty
    FROM first_scaled s LEFT JOIN first_baseline b ON s.{DEST} = b.{DEST} AND s.{DAY} = b.{DAY}""",
)
cte("second_scaled", ["second_master"], scaled_sql("second_master", ["destination_base_difficulty"]))
cte(
    "second_scored",
    ["second_scaled"],
    scored_sql("second_scaled", [*FIRST, "destination_base_difficulty"], FULL_WEIGHTS),
)


def consistency_sql(source: str) -> str:
    return f"""SELECT *, ((rank() OVER (ORDER BY difficult_rate) / CAST(count(*) OVER () AS DOUBLE) + cume_dist() OVER (ORDER BY difficult_rate)) / 2
    + (rank() OVER (ORDER BY difficulty_intensity) / CAST(count(*) OVER () AS DOUBLE) + cume_dist() OVER (ORDER BY difficulty_intensity)) / 2) / 2
    AS consistency_index FROM (SELECT *, difficult_flights / CAST(flights AS DOUBLE) AS difficult_rate, 1 / (1 + mean_rank) AS difficulty_intensity
    FROM (SELECT {DEST}, count(flight_number) AS flights, count(*) FILTER (WHERE difficulty_class = 'Difficult') AS difficult_flights,
    avg(difficulty_score) AS mean_score, avg(daily_rank) AS mean_rank FROM {source} GROUP BY 1))"""


cte("slice_consistency", ["slice_scored"], consistency_sql("slice_scored"))
cte("consistency", ["scored"], consistency_sql("scored"))
TOP = f"consistency_index DESC, difficult_rate DESC, mean_score DESC, {DEST}"
cte("top_destinations", ["consistency"], f"SELECT * FROM consistency ORDER BY {TOP} LIMIT 10")
cte(
    "loads",
    ["late_flights", "bookings"],
    f"""SELECT f.*, coalesce(pax, 0) AS total_pax, coalesce(pax, 0) / CASE WHEN total_seats > 0 THEN CAST(total_seats AS DOUBLE) END AS load_factor,
    (epoch_us(actual_departure_datetime_local) - epoch_us(scheduled_departure_datetime_local)) / 60000000.0 AS dep_delay_minutes,
    scheduled_ground_time_minutes - minimum_turn_minutes AS ground_time_delta
    FROM late_flights f LEFT JOIN (SELECT flight_id, sum(total_pax) AS pax FROM bookings GROUP BY 1) USING (flight_id)""",
)
cte(
    "requested",
    ["loads", "requests"],
    "SELECT l.*, coalesce(ssr_count, 0) AS ssr_count FROM loads l LEFT JOIN requests USING (flight_id)",
)


def corr(x: str, y: str) -> str:
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"covar_samp({y}, {x}) {both} / nullif(stddev_samp({x}) {both} * stddev_samp({y}) {both}, 0)"
