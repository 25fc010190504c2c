"""Named DuckDB fragments that oracle queries are put together of."""

from __future__ import annotations

import re

WEEK_US, DAY_US = 1_704_067_200_000_000, 86_400_000_000

FRAGMENTS: dict[str, str] = {
    "raw": f"SELECT event_id, user_id, event_type, round(value * 1000000)::BIGINT AS late_us, (((epoch_us(ts) - {WEEK_US}) // {DAY_US}) % 7)::INT AS d, (epoch_us(ts) - {WEEK_US}) % {DAY_US} AS of_day, json_extract_string(props, '$.k')::INT AS k FROM events",
    "pings": f"""SELECT event_id, 'A' || (user_id % 5) AS agency_id, 'V' || user_id AS vehicle_id, user_id || '-' || d || '-' || (of_day // {DAY_US // 2}) AS trip_id,
      'L' || (user_id // 150 * 5 + user_id % 5) AS line, ((user_id // 5) % 2)::VARCHAR AS direction_id, 'S' || (user_id // 150 * 6 + k % 6) AS stop_id, k % 6 + 1 AS seq, DATE '2024-01-01' + d AS day,
      c AS created_us, c + late_us AS received_us, c - late_us AS sched_us, 38.7 + (k % 6) * 0.004 + (event_id % 97) * 0.00001 AS lat, -9.2 + (user_id % 5) * 0.003 + (user_id // 150 % 500) * 0.02 + (event_id % 89) * 0.00001 AS lon, event_type
      FROM (SELECT *, {WEEK_US} + d * {DAY_US} + 21600000000 + of_day // 2 AS c FROM raw)""",
    "packages": "SELECT n_nationkey::BIGINT AS id, 'A' || (n_nationkey % 5) AS agency_id, DATE '2024-01-01' + ((n_nationkey // 5) % 5 * 2)::INT AS active_from, DATE '2024-01-01' + ((n_nationkey // 5) % 5 * 2 + 2)::INT AS active_until FROM nation",
    "visits": f"""SELECT day, trip_id, line, direction_id, stop_id, stop_sequence, sched_us, printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) AS clock FROM (
      SELECT *, (sched_us - epoch_us(day::TIMESTAMP)) // 1000000 AS s FROM (
        SELECT day, trip_id, line, direction_id, stop_id, seq AS stop_sequence, min(sched_us) AS sched_us FROM pings GROUP BY ALL))""",
    "jams": """SELECT o_orderkey AS jam_id, 'LINESTRING(' || printf('%.3f %.3f', -9.2 + p * 0.001, 38.7 + p * 0.001) || ', ' || printf('%.3f %.3f', -9.2 + (p + 1) * 0.001, 38.7 + (p + 1) * 0.001) || ')' AS geometry_wkt,
      ['80% - 61%', '60% - 41%', '40% - 21%', '20% - 1%', 'Via bloqueada'][o_orderpriority[1]::INT] AS intensity, o_orderdate::DATE AS day, ((o_orderkey % 48) * 30)::INT AS minute,
      CASE WHEN o_orderkey % 7 > 0 THEN round(o_totalprice / 10000, 3) END AS speed_kmh FROM (SELECT *, o_custkey % 9 AS p FROM orders)""",
    "kpi_rows": "SELECT l_returnflag AS line, l_linenumber::VARCHAR AS scenario, l_linestatus AS k, (l_orderkey % 5)::INT AS day, l_suppkey AS seed, l_quantity - 20 + l_linenumber * 4 AS saved, l_linenumber % 3 AS vehicles, l_linenumber * 7 % 5 AS hold, l_linenumber * 3 % 4 AS wait FROM lineitem",
}


def sql(final: str, **own: str) -> str:
    """final with every fragment that it uses, directly or not, as a common table before it; `own` adds fragments for this query."""
    known = FRAGMENTS | own
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"(?:\bFROM|\bJOIN|,)\s*{name}\b", text):
                need(known[name])
                order.append(name)

    need(final)
    order = list(dict.fromkeys(order))
    return ("WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" if order else "") + final
