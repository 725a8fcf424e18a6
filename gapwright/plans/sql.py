"""DuckDB's words for the shared relations of the queries: series, runs, gaps and pools as common table expressions."""

from __future__ import annotations

R6 = "floor(({}) * 1e6 + 0.5003) / 1e6"


def r6(x: str, name: str) -> str:
    return f"{R6.format(x)} AS {name}"


S1 = """
d AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n, floor(avg(l_extendedprice) * 1e4 + 0.5003) / 1e4 AS v FROM lineitem GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
dense AS (SELECT cal.date, coalesce(n, 0) AS n, v FROM cal LEFT JOIN d USING (date)),
lev AS (SELECT quantile_cont(n, 0.25) AS t FROM dense),
s1 AS (SELECT date, date_diff('day', DATE '1970-01-01', date) AS x, n, v, n >= t AS e FROM dense, lev),
known AS (SELECT date, x, v FROM s1 WHERE e AND v IS NOT NULL)"""

S2 = """
s2 AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS f_count, floor(avg(o_totalprice) * 1e4 + 0.5003) / 1e4 AS f_mean FROM orders GROUP BY 1)"""

RUNS = (
    S1
    + """,
runs AS (SELECT min(x) AS x0, max(x) AS x1, count(*) AS len FROM (SELECT x, x - row_number() OVER (ORDER BY x) AS g FROM s1 WHERE e) GROUP BY g),
gaps AS (SELECT min(x) AS x0, max(x) AS x1, count(*) AS len FROM (SELECT x, x - row_number() OVER (ORDER BY x) AS g FROM s1 WHERE NOT e) GROUP BY g)"""
)

POOL = (
    RUNS
    + """,
lens AS (SELECT * FROM (VALUES (1), (3), (7), (14)) t(gap_length)),
starts AS (SELECT gap_length, unnest(generate_series(x0, x1 - gap_length + 1)) AS sx FROM runs, lens WHERE len >= gap_length),
blk AS (SELECT *, floor(sx / (4 * gap_length + 12)) AS b FROM starts WHERE floor(sx / (4 * gap_length + 12)) = floor((sx + gap_length - 1) / (4 * gap_length + 12))),
pick AS (SELECT gap_length, arg_min(sx, md5('42|' || gap_length || '|' || sx)) AS sx FROM blk GROUP BY gap_length, b),
pool AS (SELECT 'L' || lpad(gap_length::VARCHAR, 2, '0') || '_' || strftime(DATE '1970-01-01' + sx::INT, '%Y%m%d') AS gap_id, gap_length, sx AS a0, sx + gap_length - 1 AS a1,
  DATE '1970-01-01' + sx::INT AS start, DATE '1970-01-01' + (sx + gap_length - 1)::INT AS stop FROM pick),
hidden AS (SELECT gap_id, gap_length, a0, a1, unnest(generate_series(a0, a1)) AS x FROM pool)"""
)

EDGES = (
    POOL
    + """,
near AS (SELECT s1.x, max(k.x) OVER (ORDER BY s1.x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS px, min(k.x) OVER (ORDER BY s1.x ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS qx
  FROM s1 LEFT JOIN known k ON k.x = s1.x),
edge AS (SELECT pool.*, p.px AS x0, kp.v AS v0, q.qx AS x1, kq.v AS v1 FROM pool JOIN near p ON p.x = a0 JOIN near q ON q.x = a1 LEFT JOIN known kp ON kp.x = p.px LEFT JOIN known kq ON kq.x = q.qx)"""
)

PREDICTED = (
    EDGES
    + """,
lin AS (SELECT h.gap_id, h.gap_length, h.x, v0 + (h.x - x0)::DOUBLE / (x1 - x0) * (v1 - v0) AS p FROM hidden h JOIN edge USING (gap_id)),
per AS (SELECT h.gap_id, h.gap_length, h.x, v0 AS p FROM hidden h JOIN edge USING (gap_id)),
mon AS (SELECT month(date) AS m, sum(v) AS s, count(*) AS n FROM known GROUP BY 1),
own AS (SELECT gap_id, month(k.date) AS m, sum(k.v) AS s, count(*) AS n FROM hidden JOIN known k USING (x) GROUP BY 1, 2),
clim AS (SELECT h.gap_id, h.gap_length, h.x, CASE WHEN mon.n - coalesce(own.n, 0) > 0 THEN (mon.s - coalesce(own.s, 0)) / (mon.n - coalesce(own.n, 0))
   ELSE ((SELECT sum(v) FROM known) - (SELECT sum(s) FROM own o WHERE o.gap_id = h.gap_id)) / ((SELECT count(*) FROM known) - (SELECT sum(n) FROM own o WHERE o.gap_id = h.gap_id)) END AS p
  FROM hidden h LEFT JOIN mon ON mon.m = month(DATE '1970-01-01' + h.x::INT) LEFT JOIN own ON own.gap_id = h.gap_id AND own.m = mon.m),
pred AS (SELECT 'linear' AS method, * FROM lin UNION ALL SELECT 'persistence', * FROM per UNION ALL SELECT 'climatology', * FROM clim),
scored AS (SELECT pred.method, gap_id, gap_length, x, p AS prediction, s1.v AS truth, p - s1.v AS e, abs(p - s1.v) AS a FROM pred LEFT JOIN s1 USING (x))"""
)

DAY = "DATE '1970-01-01' + ({})::INT"
