"""The registered queries in DuckDB SQL, written from the definitions rather than from the plans:
smoothing and Holt-Winters run as recursions, calendar rules as interval arithmetic."""

from __future__ import annotations

from spendframe.params import FORECAST_COLUMNS, MONTH_FACTORS
from workload.queries import AS_OF

# -- series -----------------------------------------------------------------------------------

NET = "l_extendedprice * (1 - l_discount)"
SERVICE_DAILY = """SELECT event_type AS service, CAST(ts AS DATE) AS period_start, round(sum(value), 6) AS cost
FROM events GROUP BY 1, 2"""
ACCOUNT_DAILY = """SELECT user_id AS account, event_type AS service, CAST(ts AS DATE) AS period_start,
round(sum(value), 6) AS cost FROM events GROUP BY 1, 2, 3"""
LINE_DAILY = f"""SELECT l_returnflag AS service, CAST(l_shipdate AS DATE) AS period_start,
round(sum({NET}), 6) AS cost FROM lineitem GROUP BY 1, 2"""
SUPPLIER_DAILY = f"""SELECT l_suppkey AS service, CAST(l_shipdate AS DATE) AS period_start,
round(sum({NET}), 6) AS cost FROM lineitem GROUP BY 1, 2"""
MONTHLY = """SELECT o_orderpriority AS service, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start,
round(sum(o_totalprice), 6) AS cost FROM orders GROUP BY 1, 2"""
MIXED = f"""SELECT 'daily' AS kind, service, period_start, cost FROM ({SERVICE_DAILY})
UNION ALL SELECT 'firsts', service, period_start, cost FROM ({MONTHLY})
UNION ALL SELECT 'ends', service, last_day(period_start), cost FROM ({MONTHLY})"""
ORDER_DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders"


def numbered(series: str, keys: str = "service") -> str:
    """``k`` counts rows from the oldest, ``n`` is the length of the series."""
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY period_start, cost) - 1 AS k,
count(*) OVER (PARTITION BY {keys}) AS n FROM ({series})"""


DAILY_STEP = "CAST(last + CAST(h AS INTEGER) AS DATE)"
MONTHLY_STEP = "CAST(date_trunc('month', last) + to_months(CAST(h AS INTEGER)) AS DATE)"
DAYS = "unnest(generate_series(1, 365)) AS h"
MONTHS = "unnest(generate_series(1, 12)) AS h"


def flat_forecast(series: str, value: str, keys: str = "service", where: str = "n >= 10") -> str:
    """A forecast that does not depend on the step."""
    return f"""WITH k AS ({numbered(series, keys)}),
f AS (SELECT {keys}, max(period_start) AS last, {value} AS value FROM k WHERE {where} GROUP BY {keys}),
x AS (SELECT *, {DAYS} FROM f)
SELECT {keys}, {DAILY_STEP} AS period_start, round(value, 4) AS value FROM x"""


def smoothing(alpha: float) -> str:
    return (
        f"sum(pow(CAST({1 - alpha} AS DOUBLE), n - 1 - k) * "
        f"CASE WHEN k = 0 THEN CAST(1 AS DOUBLE) ELSE CAST({alpha} AS DOUBLE) END * cost)"
    )


def hw_ctes(m: int) -> str:
    """Recursion over ``k``; ``hw`` ends with one row per series: level, trend, season list."""
    return f"""hw0 AS (SELECT service, avg(cost) FILTER (k < {m}) AS l,
  (avg(cost) FILTER (k >= {m} AND k < {2 * m}) - avg(cost) FILTER (k < {m})) / {m} AS t,
  list(cost ORDER BY k) FILTER (k < {m}) AS head FROM k WHERE n >= {2 * m} GROUP BY service),
hwr AS (SELECT service, CAST({m - 1} AS BIGINT) AS k, l, t, list_transform(head, lambda v: v / nullif(l, 0)) AS s FROM hw0
  UNION ALL
  SELECT service, k, l2, CAST(0.1 AS DOUBLE) * (l2 - l) + CAST(0.9 AS DOUBLE) * t,
    list_append(s[2:], CAST(0.1 AS DOUBLE) * v / nullif(l2, 0) + CAST(0.9 AS DOUBLE) * s[1])
  FROM (SELECT hwr.service, k.k, hwr.l, hwr.t, hwr.s, k.cost AS v,
      CAST(0.3 AS DOUBLE) * k.cost / nullif(hwr.s[1], 0) + CAST(0.7 AS DOUBLE) * (hwr.l + hwr.t) AS l2
    FROM hwr JOIN k ON k.service = hwr.service AND k.k = hwr.k + 1)),
hw AS (SELECT service, arg_max(l, k) AS hl, arg_max(t, k) AS ht, arg_max(s, k) AS hs FROM hwr GROUP BY service)"""


THETA_CTES = """line AS (SELECT service, regr_slope(cost, k) AS a, regr_intercept(cost, k) AS b, max(n) AS n,
  max(period_start) AS last, max(cost) FILTER (k = n - 1) AS v1, max(cost) FILTER (k = n - 2) AS v2
  FROM k WHERE n >= 10 GROUP BY service),
th AS (SELECT *, 2 * (v1 - (a * (n - 1) + b)) + (a * (n - 1) + b) AS z1,
  2 * (v2 - (a * (n - 2) + b)) + (a * (n - 2) + b) AS z2 FROM line)"""
THETA_VALUE = "a * (n + h - 1) + b + (2 * z1 - z2 - (a * (n - 1) + b))"


def all_methods(series: str, steps: str, step_date: str, m: int = 12) -> str:
    """CTEs ending in ``f``: service, last, h, period_start and the forecast columns."""
    return f"""WITH RECURSIVE k AS ({numbered(series)}),
{hw_ctes(m)},
{THETA_CTES},
flat AS (SELECT service, avg(cost) FILTER (k >= n - 7) AS sma, {smoothing(0.5)} AS es, {smoothing(0.3)} AS es3
  FROM k WHERE n >= 10 GROUP BY service),
x AS (SELECT *, {steps} FROM th JOIN flat USING (service) LEFT JOIN hw USING (service)),
g AS (SELECT service, last, h, {step_date} AS period_start, sma, es,
  CASE WHEN n >= {2 * m} THEN (hl + h * ht) * hs[CAST((h - 1) % {m} + 1 AS BIGINT)] ELSE es3 END AS hw,
  {THETA_VALUE} AS theta FROM x),
f AS (SELECT *, (coalesce(sma, 0) + coalesce(es, 0) + coalesce(hw, 0) + coalesce(theta, 0)) / nullif(
  (sma IS NOT NULL)::INT + (es IS NOT NULL)::INT + (hw IS NOT NULL)::INT + (theta IS NOT NULL)::INT, 0) AS ensemble FROM g)"""


ON = ("sma", "es", "hw", "theta", "ensemble")


def column_list(digits: int = 4) -> str:
    return ", ".join(f"{f'round({c}, {digits})' if c in ON else 'CAST(NULL AS DOUBLE)'} AS {c}" for c in FORECAST_COLUMNS)


def table_of(series: str, steps: str, step_date: str, digits: int = 4) -> str:
    empty = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in FORECAST_COLUMNS)
    return f"""{all_methods(series, steps, step_date)}
SELECT service, period_start, cost, {empty} FROM k WHERE n >= 10
UNION ALL SELECT service, period_start, NULL, {column_list(digits)} FROM f"""


# -- budgets ----------------------------------------------------------------------------------


def budget_sql(costs: str = SERVICE_DAILY, where: str = "TRUE") -> str:
    used = 'ActualCost / nullif(BudgetAmount, 0) * 100'
    return f"""SELECT period_start AS "PeriodStart", service, BudgetName AS "BudgetName", BudgetAmount AS "BudgetAmount",
  ActualCost AS "ActualCost",
  round(CASE WHEN BudgetAmount = 0 THEN 0 ELSE BudgetAmount - ActualCost END, 6) AS "Variance",
  round(CASE WHEN BudgetAmount = 0 THEN 0 ELSE (ActualCost - BudgetAmount) / nullif(BudgetAmount, 0) * 100 END, 6)
    AS "VariancePercent",
  CASE WHEN BudgetAmount = 0 THEN 'NO_BUDGET' WHEN {used} >= 100 THEN 'OVER_BUDGET'
    WHEN {used} >= 80 THEN 'THRESHOLD_BREACH' ELSE 'UNDER_BUDGET' END AS "Status"
FROM (SELECT period_start, service, cost AS ActualCost, r_name AS BudgetName,
  CAST(r_regionkey * 1000 AS DOUBLE) AS BudgetAmount FROM ({costs}) CROSS JOIN region) WHERE {where}"""


# -- anomalies --------------------------------------------------------------------------------

ROLLING_SMA = """SELECT service, period_start, 'sma' AS method, avg(cost) OVER (PARTITION BY service
  ORDER BY period_start, cost ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS value FROM k"""
ROLLING_ES = "SELECT service, period_start, 'es' AS method, level AS value FROM esr"


def es_ctes(series: str, where: str = "TRUE") -> str:
    return f"""WITH RECURSIVE k AS (SELECT * FROM ({numbered(series)}) WHERE {where}),
esr AS (SELECT service, period_start, k, cost AS level FROM k WHERE k = 0
  UNION ALL SELECT k.service, k.period_start, k.k, CAST(0.5 AS DOUBLE) * k.cost + CAST(0.5 AS DOUBLE) * esr.level
  FROM esr JOIN k ON k.service = esr.service AND k.k = esr.k + 1)"""


def anomaly_sql(series: str, values: str, key: str = "service", where: str = "TRUE") -> str:
    return f"""{es_ctes(series, where)},
v AS ({values}), p AS (SELECT * FROM (VALUES ('Day Before Yesterday', 2), ('Week Ago', 7), ('Month Ago', 30),
  ('Quarter Ago', 90)) AS t(period, back)),
g AS (SELECT DISTINCT service, method FROM v), y AS (SELECT DATE '{AS_OF}' - 1 AS yesterday),
d AS (SELECT g.service, g.method, p.period, (a.value - b.value) / nullif(b.value, 0) * 100 AS change
  FROM g CROSS JOIN p CROSS JOIN y
  LEFT JOIN v a ON a.service = g.service AND a.method = g.method AND a.period_start = yesterday
  LEFT JOIN v b ON b.service = g.service AND b.method = g.method AND b.period_start = yesterday - back)
SELECT service AS {key}, method, period, round(change, 4) AS change_pct,
  CASE WHEN abs(change) > 20 THEN 'Y' ELSE 'N' END AS anomaly FROM d"""


# -- events -----------------------------------------------------------------------------------


def event_sql(series: str, start: str, inside: str, change: str) -> str:
    return f"""SELECT service, period_start, round(greatest(CASE WHEN {inside} THEN {change} ELSE cost END, 0), 6) AS cost
FROM (SELECT *, row_number() OVER (PARTITION BY service, period_start >= DATE '{start}' ORDER BY period_start, cost) AS r,
  period_start >= DATE '{start}' AS later FROM ({series}))"""


def season_sql(factors) -> str:
    listed = ", ".join(f"CAST({f} AS DOUBLE)" for f in factors)
    return f"SELECT service, period_start, round(cost * ([{listed}])[month(period_start)], 4) AS cost FROM ({MONTHLY})"


def uniform(salt: str, keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('#', '42', '{salt}', {keys})), 1, 8))::BIGINT / CAST(4294967296 AS DOUBLE))"


def generated(value: str, periods: int = 36, grain: str = "daily") -> str:
    day = "DATE '2024-01-15' + CAST(i AS INTEGER)"
    if grain == "monthly":
        day = "CAST(DATE '2024-02-01' + to_months(CAST(i AS INTEGER)) AS DATE)"
    return f"""SELECT series, {day} AS period_start, round(greatest({value}, 0), 4) AS cost FROM (
SELECT s_suppkey AS series, s_acctbal AS baseline, s_nationkey * 2.5 AS trend, unnest(generate_series(0, {periods - 1})) AS i
FROM supplier)"""


def ranges_sql() -> str:
    return """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders),
c AS (SELECT * FROM d CROSS JOIN (VALUES ('hourly'), ('daily'), ('monthly')) AS a(grain)
  CROSS JOIN (VALUES ('none'), ('day'), ('week'), ('month'), ('quarter'), ('semester'), ('year')) AS b("interval")
  CROSS JOIN (VALUES (FALSE), (TRUE)) AS t(include_today)),
r AS (SELECT *, CASE
    WHEN "interval" = 'none' AND grain = 'hourly' THEN as_of - 1
    WHEN "interval" = 'none' AND grain = 'daily' THEN as_of - 7
    WHEN "interval" = 'none' THEN CAST(date_trunc('month', CAST(date_trunc('month', as_of) AS DATE) - 365) AS DATE)
    WHEN "interval" = 'day' THEN as_of WHEN "interval" = 'week' THEN as_of - 6
    WHEN "interval" = 'month' THEN make_date(year(as_of), month(as_of), 1)
    WHEN "interval" = 'quarter' THEN make_date(year(as_of), (quarter(as_of) - 1) * 3 + 1, 1)
    WHEN "interval" = 'semester' THEN make_date(year(as_of), CASE WHEN month(as_of) < 7 THEN 1 ELSE 7 END, 1)
    ELSE make_date(year(as_of), 1, 1) END AS s,
  CASE WHEN include_today THEN as_of + 1
    WHEN "interval" = 'none' AND grain = 'monthly' THEN make_date(year(as_of), month(as_of), 1) ELSE as_of END AS e FROM c)
SELECT as_of, grain, "interval", include_today,
  CAST(s AS VARCHAR) || CASE WHEN grain = 'hourly' THEN 'T00:00:00Z' ELSE '' END AS range_start,
  CAST(e AS VARCHAR) || CASE WHEN grain = 'hourly' THEN 'T00:00:00Z' ELSE '' END AS range_end FROM r"""


SPANS = f"""WITH s AS (SELECT *, lag(period_start) OVER (PARTITION BY kind, service ORDER BY period_start) AS p FROM ({MIXED})),
spans AS (SELECT kind, service, CASE WHEN bool_and(day(period_start) = 1) OR (bool_and(period_start = last_day(period_start))
  AND bool_and(p IS NULL OR datediff('month', p, period_start) = 1) AND count(*) >= 3) THEN 'monthly' ELSE 'daily' END AS grain,
  max(period_start) AS last, count(*) AS row_count FROM s GROUP BY 1, 2)"""

ARIMA_110 = f"""WITH k AS ({numbered(LINE_DAILY)}),
d AS (SELECT *, cost - lag(cost) OVER (PARTITION BY service ORDER BY k) AS d FROM k),
e AS (SELECT *, lag(d) OVER (PARTITION BY service ORDER BY k) AS d1 FROM d),
f AS (SELECT service, max(period_start) AS last, arg_max(cost, k) AS v, arg_max(d, k) AS dl,
  sum(d * d1) / sum(d1 * d1) FILTER (d IS NOT NULL) AS phi FROM e GROUP BY 1),
x AS (SELECT *, {DAYS} FROM f)
SELECT service, {DAILY_STEP} AS period_start, round(v + dl * phi * (1 - pow(phi, h)) / (1 - phi), 4) AS value FROM x"""


#: Theta on the series without its season, where the autocorrelation at twelve steps is more than chance gives
THETA_SEASONAL = f"""WITH k AS ({numbered(MONTHLY)}), c AS (SELECT *, cost - avg(cost) OVER (PARTITION BY service) AS d FROM k),
lags AS (SELECT a.service, a.n, b.k - a.k AS lag, sum(a.d * b.d) AS s FROM c a JOIN c b ON a.service = b.service AND b.k - a.k BETWEEN 1 AND 12 GROUP BY ALL),
total AS (SELECT service, sum(d * d) AS t FROM c GROUP BY 1),
test AS (SELECT service, abs(max(s / t) FILTER (lag = 12)) > 1.645 * sqrt((1 + 2 * sum((s / t) * (s / t)) FILTER (lag < 12)) / max(n))
  OR abs(min(s / t) FILTER (lag = 12)) > 1.645 * sqrt((1 + 2 * sum((s / t) * (s / t)) FILTER (lag < 12)) / max(n)) AS seasonal
  FROM lags JOIN total USING (service) GROUP BY 1),
smooth AS (SELECT *, (sum(cost) OVER (PARTITION BY service ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
  + (lag(cost, 6) OVER (PARTITION BY service ORDER BY k) + lead(cost, 6) OVER (PARTITION BY service ORDER BY k)) / 2) / 12 AS trend FROM k),
phases AS (SELECT service, k % 12 AS phase, avg(cost / trend) AS f FROM smooth WHERE trend IS NOT NULL GROUP BY 1, 2),
factors AS (SELECT service, phase, CASE WHEN seasonal THEN f / avg(f) OVER (PARTITION BY service) ELSE 1 END AS f FROM phases JOIN test USING (service)),
plain AS (SELECT k.*, cost / f AS v FROM k JOIN factors p ON p.service = k.service AND p.phase = k.k % 12),
line AS (SELECT service, n, max(period_start) AS last, regr_slope(v, k - n + 1) AS b, regr_intercept(v, k - n + 1) AS a,
  arg_max(v, k) AS v0, max(v) FILTER (k = n - 2) AS v1 FROM plain GROUP BY 1, 2),
x AS (SELECT *, {MONTHS} FROM line)
SELECT x.service, {MONTHLY_STEP} AS period_start, round(p.f * (a + b * h
  + 2 * (2 * (v0 - a) + a) - (2 * (v1 - (a - b)) + a - b) - a), 2) AS value
FROM x JOIN factors p ON p.service = x.service AND p.phase = (x.n + h - 1) % 12"""

#: Design rows of the tree models: twelve scaled values before an origin, a step, and the value so many steps on
DIRECT = f"""WITH k AS ({numbered(MONTHLY)}), s AS (SELECT service, avg(abs(cost)) AS level FROM k GROUP BY 1),
v AS (SELECT k.*, cost / level AS x FROM k JOIN s USING (service)),
o AS (SELECT service, k + 1 AS origin, n, {", ".join(f"lag(x, {i}) OVER (PARTITION BY service ORDER BY k) AS lag_{i + 1}" if i else "x AS lag_1" for i in range(12))}
  FROM v QUALIFY k >= 11 AND k < n - 1)
SELECT o.service, o.origin, v.k + 1 - o.origin AS step, v.x AS label, {", ".join(f"lag_{i}" for i in range(1, 13))}
FROM o JOIN v ON v.service = o.service AND v.k + 1 - o.origin BETWEEN 1 AND 12"""
DIRECT_BINS = " UNION ALL ".join(
    [f"SELECT {i - 1} AS feature, greatest(0, least(63, floor(lag_{i} * 8)))::BIGINT AS bin, label FROM d" for i in range(1, 13)]
    + ["SELECT 12, greatest(0, least(63, ceil(step / 12 * 64) - 1))::BIGINT, label FROM d"]
)

#: The exact likelihood of x ~ ARMA(1, 1) by its innovations: errors e with variances f of one for a variance of one,
#: f[0] from the stationary variance; -2/n times the log-likelihood, but for constants.
ARMA_11 = """list_reduce(list_prepend(
    struct_pack(x := x[1], e := x[1], f := greatest((1 + 2 * {t} * {p} + {t} * {t}) / (1 - {p} * {p}), 1e-9), s := 0.0::DOUBLE, g := 0.0::DOUBLE),
    list_transform(x[2:], lambda v: struct_pack(x := v, e := 0.0::DOUBLE, f := 0.0::DOUBLE, s := 0.0::DOUBLE, g := 0.0::DOUBLE))),
  lambda a, b: struct_pack(x := b.x, e := b.x - {p} * a.x - {t} * a.e / a.f, f := 1 + {t} * {t} - {t} * {t} / a.f,
    s := a.s + a.e * a.e / a.f, g := a.g + ln(a.f)))"""


def arma_11(differences: str, undo: str, days: str, step: str) -> str:
    """Best (phi, theta) by a compass search from the best point of a grid, then the forecast.

    ``differences``: one row a service with ``x`` (the differenced series) and what ``undo`` needs."""
    value = ARMA_11.format(p="p", t="t")
    score = f"""(SELECT ln((r.s + r.e * r.e / r.f) / len(x)) + (r.g + ln(r.f)) / len(x) FROM (SELECT {value} AS r))"""
    moves = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) AS m(i, j)"
    return f"""WITH RECURSIVE z AS ({differences}),
grid AS (SELECT service, x, a.v / 10.0 AS p, b.v / 10.0 AS t FROM z, range(-9, 10) AS a(v), range(-9, 10) AS b(v)),
first AS (SELECT service, x, arg_min(struct_pack(p := p, t := t), y) AS spot FROM (SELECT *, {score} AS y FROM grid) GROUP BY ALL),
search AS (
  SELECT service, x, spot.p AS p, spot.t AS t, 0.05::DOUBLE AS h FROM first
  UNION ALL
  SELECT service, x, best.p, best.t, CASE WHEN best.i = 0 AND best.j = 0 THEN h / 2 ELSE h END FROM (
    SELECT service, x, h, arg_min(struct_pack(p := p, t := t, i := i, j := j), (y, abs(i) + abs(j), i, j)) AS best FROM (
      SELECT *, {score} AS y FROM (
        SELECT service, x, h, i, j, greatest(least(p + i * h, 0.9999), -0.9999) AS p, greatest(least(t + j * h, 0.9999), -0.9999) AS t
        FROM search, {moves} WHERE h > 1e-9)) GROUP BY service, x, h)
), done AS (SELECT service, x, p, t FROM search WHERE h <= 1e-9),
ends AS (SELECT service, p, x, p * r.x + t * r.e / r.f AS next FROM (SELECT *, {value} AS r FROM done)),
f AS (SELECT z.*, e.p, e.next FROM ends e JOIN z ON e.service = z.service), steps AS (SELECT *, {days} FROM f)
SELECT service, {step} AS period_start, {undo} AS value FROM steps"""


ARIMA_111 = arma_11(
    f"""SELECT service, max(period_start) AS last, arg_max(cost, k) AS v, list(d ORDER BY k) FILTER (d IS NOT NULL) AS x
    FROM (SELECT *, cost - lag(cost) OVER (PARTITION BY service ORDER BY k) AS d FROM ({numbered(LINE_DAILY)})) GROUP BY service""",
    "round(v + next * (1 - pow(p, h)) / (1 - p), -2)", DAYS, DAILY_STEP,
)
#: differenced at lag 12 and at lag 1: (1, 1, 1)(0, 1, 0, 12)
SARIMA_111_010 = arma_11(
    f"""SELECT service, max(period_start) AS last, list(cost ORDER BY k) AS c, list(d ORDER BY k) FILTER (d IS NOT NULL) AS x
    FROM (SELECT *, s - lag(s) OVER (PARTITION BY service ORDER BY k) AS d FROM (
      SELECT *, cost - lag(cost, 12) OVER (PARTITION BY service ORDER BY k) AS s FROM ({numbered(MONTHLY)}))) GROUP BY service""",
    "round(c[len(c) - 12 + h] + c[len(c)] - c[len(c) - 12] + next * (1 - pow(p, h)) / (1 - p), -4)", MONTHS, MONTHLY_STEP,
)
#: AR(1) of differences: the derivative of its exact likelihood is a cubic with one root inside (-1, 1), found by halving
ARIMA_110_EXACT = f"""WITH RECURSIVE k AS ({numbered(LINE_DAILY)}),
d AS (SELECT *, cost - lag(cost) OVER (PARTITION BY service ORDER BY k) AS d FROM k),
e AS (SELECT *, lag(d) OVER (PARTITION BY service ORDER BY k) AS d1, row_number() OVER (PARTITION BY service ORDER BY k DESC) AS back FROM d),
f AS (SELECT service, max(period_start) AS last, arg_max(cost, k) AS v, arg_max(d, k) AS dl, count(d) AS n,
  sum(d * d) AS a, sum(d * d1) AS b, sum(d1 * d1) FILTER (k > 2) AS c FROM e GROUP BY 1),
g AS (SELECT *, -1.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0 AS i FROM f
  UNION ALL SELECT * EXCLUDE (m, y) REPLACE (CASE WHEN y > 0 THEN m ELSE low END AS low, CASE WHEN y > 0 THEN high ELSE m END AS high, i + 1 AS i)
  FROM (SELECT *, ((n - 1) * c * m - (n - 2) * b) * m * m - (n * c + a) * m + n * b AS y FROM (SELECT *, (low + high) / 2 AS m FROM g WHERE i < 60))),
h AS (SELECT *, (low + high) / 2 AS phi FROM g WHERE i = 60), x AS (SELECT *, {DAYS} FROM h)
SELECT service, {DAILY_STEP} AS period_start, round(v + dl * phi * (1 - pow(phi, h)) / (1 - phi), 1) AS value FROM x"""


def report_sql(series: str, key: str = "service", name: str = "Service") -> str:
    return f"""SELECT CAST(period_start AS VARCHAR) AS "PeriodStart", {key} AS "{name}",
printf('%.6f', cost) AS "UnblendedCost" FROM ({series})"""


PAGES = f"""SELECT CAST(period_start AS VARCHAR) AS "PeriodStart", service AS "Service",
CASE WHEN day(period_start) = 13 THEN '' ELSE printf('%.6f', cost) END AS "UnblendedCost" FROM ({SERVICE_DAILY})"""
TOTAL_DAILY = """SELECT 'Total' AS service, CAST(ts AS DATE) AS period_start, round(sum(value), 6) AS cost
FROM events GROUP BY 2"""
STEP_TABLES = {
    "daily": (SERVICE_DAILY, DAYS, DAILY_STEP),
    "monthly": (MONTHLY, MONTHS, MONTHLY_STEP),
}


def oracle_sql() -> dict[str, str]:
    daily, monthly = STEP_TABLES["daily"], STEP_TABLES["monthly"]
    noise = (
        f"sqrt(-2.0 * ln(1.0 - {uniform('noise-r', 'CAST(series AS VARCHAR), CAST(i AS VARCHAR)')})) * "
        f"cos(2.0 * pi() * {uniform('noise-a', 'CAST(series AS VARCHAR), CAST(i AS VARCHAR)')})"
    )
    draw = "service, CAST(period_start AS VARCHAR)"
    in_history = (
        f"period_start >= CAST(DATE '{AS_OF}' - INTERVAL 3 MONTH AS DATE) - 10 AND period_start < DATE '{AS_OF}'"
    )
    recent = f"SELECT * FROM ({LINE_DAILY}) WHERE {in_history}"
    queries = {
        "cost_by_service_daily": SERVICE_DAILY,
        "cost_by_account_daily": """SELECT user_id AS account, CAST(ts AS DATE) AS period_start,
            round(sum(value), 6) AS cost FROM events GROUP BY 1, 2""",
        "cost_by_tag_daily": """SELECT json_extract_string(props, '$.k') AS tag_value, CAST(ts AS DATE) AS period_start,
            round(sum(value), 6) AS cost FROM events GROUP BY 1, 2""",
        "cost_total_daily": TOTAL_DAILY,
        "cost_by_service_hourly": """SELECT event_type AS service, date_trunc('hour', ts) AS period_start,
            round(sum(value), 6) AS cost FROM events GROUP BY 1, 2""",
        "cost_by_priority_monthly": MONTHLY,
        "cost_year_to_date": f"""SELECT * FROM ({LINE_DAILY})
            WHERE period_start >= DATE '2001-01-01' AND period_start < DATE '{AS_OF}'""",
        "cost_report_semester": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS "PeriodStart",
            o_orderpriority AS "Service", round(sum(o_totalprice), 6) AS "UnblendedCost" FROM orders
            WHERE o_orderdate >= DATE '2000-07-01' AND o_orderdate < DATE '2000-11-21' GROUP BY 1, 2""",
        "report_json_grouped": report_sql(SERVICE_DAILY),
        "report_json_pages": PAGES,
        "report_pages_files": PAGES,
        "report_json_pages_total": f"""SELECT CAST(period_start AS VARCHAR) AS "PeriodStart", 'Total' AS "Group",
            printf('%.6f', count(*)::DOUBLE) AS "UnblendedCost" FROM ({SERVICE_DAILY}) GROUP BY 1""",
        "csv_files": SERVICE_DAILY,
        "json_document": f"SELECT 'costs' AS command, * FROM ({SERVICE_DAILY})",
        "cost_explicit_range": """SELECT event_type AS "Service", CAST(ts AS DATE) AS "PeriodStart", round(sum(value), 6) AS "UnblendedCost"
            FROM events WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-20' GROUP BY 1, 2""",
        "report_json_total": report_sql(TOTAL_DAILY, name="Group"),
        "report_pages_union": f"{report_sql(SERVICE_DAILY)} UNION ALL {report_sql(MONTHLY)}",
        "report_amount_fmt": """SELECT event_id, CASE event_type WHEN 'error' THEN 'n/a error' WHEN 'signup' THEN ''
            ELSE printf('%.6f', value) END AS amount FROM events""",
        "clean_series": """SELECT event_id, CAST(ts AS DATE) AS day, value AS amount FROM events
            WHERE event_type NOT IN ('error', 'view', 'signup')""",
        "series_length_gate": f"""SELECT account, service, period_start, cost FROM (
            SELECT *, count(*) OVER (PARTITION BY account, service) AS n FROM ({ACCOUNT_DAILY})) WHERE n >= 10""",
        "series_skipped": f"""SELECT account, service, count(*) AS row_count FROM ({ACCOUNT_DAILY})
            GROUP BY 1, 2 HAVING count(*) < 10""",
        "distinct_groups": """SELECT DISTINCT json_extract_string(props, '$.k') AS tag_value FROM events
            WHERE json_extract_string(props, '$.k') IS NOT NULL""",
        "infer_granularity": f"{SPANS} SELECT kind, service, grain, last AS last_date, row_count FROM spans",
        "forecast_dates": f"""{SPANS} SELECT kind, service, CAST(h AS INTEGER) AS step,
            CASE WHEN grain = 'monthly' THEN {MONTHLY_STEP} ELSE {DAILY_STEP} END AS period_start
            FROM (SELECT *, unnest(generate_series(1, CASE WHEN grain = 'monthly' THEN 12 ELSE 365 END)) AS h FROM spans)""",
        "milestone_dates": f"""WITH n AS (SELECT d, d + 1 AS nx FROM ({ORDER_DAYS})), m AS (
            SELECT d, 'end_of_this_month' AS label, last_day(nx) AS e FROM n
            UNION ALL SELECT d, 'end_of_next_month', last_day(CAST(nx + INTERVAL 1 MONTH AS DATE)) FROM n
            UNION ALL SELECT d, 'end_of_next_quarter', CAST(date_trunc('quarter', nx) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) FROM n
            UNION ALL SELECT d, 'end_of_following_quarter',
              CAST(date_trunc('quarter', nx) + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) FROM n
            UNION ALL SELECT d, 'end_of_year', make_date(year(nx), 12, 31) FROM n)
            SELECT d AS last_date, label, e AS milestone_date FROM m""",
        "date_range_matrix": ranges_sql(),
        "anomaly_dates": f"""SELECT d AS as_of, d AS today, d - 1 AS yesterday, d - 2 AS day_before_yesterday,
            d - 7 AS week_ago, CAST(d - INTERVAL 1 MONTH AS DATE) AS month_ago,
            CAST(d - INTERVAL 3 MONTH AS DATE) AS quarter_ago FROM ({ORDER_DAYS})""",
        "forecast_sma": flat_forecast(LINE_DAILY, "avg(cost) FILTER (k >= n - 7)"),
        "forecast_es": flat_forecast(LINE_DAILY, smoothing(0.5)),
        "forecast_hw": f"""{all_methods(*monthly)} SELECT service, period_start, round(hw, 4) AS value FROM f""",
        "forecast_hw_daily": f"""{all_methods(LINE_DAILY, DAYS, DAILY_STEP, m=7)}
            SELECT service, period_start, round(hw, 4) AS value FROM f""",
        "forecast_hw_short": flat_forecast(ACCOUNT_DAILY, smoothing(0.3), "account, service"),
        "forecast_theta": f"""WITH k AS ({numbered(LINE_DAILY)}), {THETA_CTES}, x AS (SELECT *, {DAYS} FROM th)
            SELECT service, {DAILY_STEP} AS period_start, round({THETA_VALUE}, 4) AS value FROM x""",
        "forecast_constant_guard": flat_forecast(
            f"""SELECT 'cost' AS kind, * FROM ({SERVICE_DAILY}) UNION ALL
            SELECT 'flat', event_type, CAST(ts AS DATE), round(max(length(event_type) / 3.0), 6) FROM events GROUP BY 2, 3""",
            """CASE WHEN greatest(max(cost) - arg_min(cost, k), arg_min(cost, k) - min(cost))
            <= 1e-8 + 1e-5 * abs(arg_min(cost, k)) THEN arg_max(cost, k) END""",
            "kind, service",
        ),
        "cost_exact_daily": """SELECT event_type AS service, CAST(ts AS DATE) AS period_start,
            CAST(CAST(sum(CAST(value AS DECIMAL(28, 10))) AS DECIMAL(28, 6)) AS VARCHAR) AS cost FROM events GROUP BY 1, 2""",
        "forecast_ar1_diff": ARIMA_110,
        "forecast_arima_110": ARIMA_110,
        "forecast_arima_110_exact": ARIMA_110_EXACT,
        "forecast_arima": ARIMA_111,
        "forecast_sarima_111_010": SARIMA_111_010,
        "forecast_seasonal_naive": f"""WITH k AS ({numbered(MONTHLY)}),
            f AS (SELECT service, max(period_start) AS last, list(cost ORDER BY k) AS v FROM k GROUP BY 1),
            x AS (SELECT *, {MONTHS} FROM f)
            SELECT service, {MONTHLY_STEP} AS period_start, round(v[len(v) - 12 + h], 4) AS value FROM x""",
        "forecast_trend_line": f"""WITH s AS ({LINE_DAILY}), f AS (SELECT service, max(period_start) AS last,
              regr_slope(cost, period_start - DATE '1995-01-01') AS a,
              regr_intercept(cost, period_start - DATE '1995-01-01') AS b FROM s GROUP BY 1),
            x AS (SELECT *, {DAYS} FROM f)
            SELECT service, {DAILY_STEP} AS period_start, round(b + a * ({DAILY_STEP} - DATE '1995-01-01'), 2) AS value FROM x""",
        "direct_design": f"""SELECT service, origin::INTEGER AS origin, step::INTEGER AS step, round(label, 6) AS label,
            {", ".join(f"round(lag_{i}, 6) AS lag_{i}" for i in range(1, 13))} FROM ({DIRECT})""",
        "boosting_first_split": f"""WITH d AS ({DIRECT}), b AS ({DIRECT_BINS}),
            h AS (SELECT feature, bin, sum(1 - label) AS g, count(*) AS h FROM b GROUP BY 1, 2),
            c AS (SELECT feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS g,
              sum(h) OVER (PARTITION BY feature) AS h FROM h WINDOW w AS (PARTITION BY feature ORDER BY bin))
            SELECT feature, bin, hl::BIGINT AS rows_left,
              round(0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)), 3) AS gain FROM c WHERE hl < h""",
        "smoothing_models": f"SELECT DISTINCT service, true AS no_worse, true AS inside, 14 AS n_states FROM ({MONTHLY})",
        "forecast_theta_seasonal": THETA_SEASONAL,
        "sarima_models": f"SELECT DISTINCT service, true AS inside, true AS at_maximum, 1 AS n_ar FROM ({MONTHLY})",
        "trend_models": f"SELECT DISTINCT service, 25 AS n_bends, true AS mostly_zero, true AS optimal FROM ({LINE_DAILY})",
        "lag_features": f"""SELECT * FROM (SELECT service, period_start, cost, {", ".join(
            f"lag(cost, {i}) OVER (PARTITION BY service ORDER BY period_start, cost) AS lag_{i}" for i in range(1, 13)
        )} FROM ({LINE_DAILY})) WHERE lag_12 IS NOT NULL""",
        "forecast_lag1_linear": f"""WITH k AS ({numbered(LINE_DAILY)}),
            l AS (SELECT *, lag(cost) OVER (PARTITION BY service ORDER BY k) AS p FROM k),
            f AS (SELECT service, max(period_start) AS last, arg_max(cost, k) AS v, regr_slope(cost, p) AS a,
              regr_intercept(cost, p) AS b FROM l GROUP BY 1), x AS (SELECT *, {DAYS} FROM f)
            SELECT service, {DAILY_STEP} AS period_start,
              round(pow(a, h) * v + b * (1 - pow(a, h)) / (1 - a), 4) AS value FROM x""",
        "rolling_sma": f"""SELECT account, service, period_start, round(avg(cost) OVER (PARTITION BY account, service
            ORDER BY period_start ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS value FROM ({ACCOUNT_DAILY})""",
        "rolling_es": f"""{es_ctes(LINE_DAILY)} SELECT service, period_start, round(level, 2) AS value FROM esr""",
        "forecast_table": table_of(*daily),
        "forecast_table_monthly": table_of(*monthly),
        "forecast_table_suppliers": table_of(SUPPLIER_DAILY, DAYS, DAILY_STEP, digits=2),
        "forecast_ensemble": f"{all_methods(*monthly)} SELECT service, period_start, round(ensemble, 4) AS value FROM f",
        "forecast_long": f"""SELECT service, period_start, m.method, CASE m.method {" ".join(
            f"WHEN '{c}' THEN {c}" for c in FORECAST_COLUMNS)} END AS value
            FROM ({table_of(*daily)}) CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in FORECAST_COLUMNS)}) AS m(method)""",
        "milestone_summary": f"""{all_methods(*daily)},
            e AS (SELECT DISTINCT service, last, last + 1 AS nx FROM f),
            m AS (SELECT service, 'end_of_this_month' AS label, last_day(nx) AS d FROM e
              UNION ALL SELECT service, 'end_of_next_month', last_day(CAST(nx + INTERVAL 1 MONTH AS DATE)) FROM e
              UNION ALL SELECT service, 'end_of_next_quarter',
                CAST(date_trunc('quarter', nx) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) FROM e
              UNION ALL SELECT service, 'end_of_following_quarter',
                CAST(date_trunc('quarter', nx) + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) FROM e
              UNION ALL SELECT service, 'end_of_year', make_date(year(nx), 12, 31) FROM e),
            c AS (SELECT m.service, label, d, method, CASE method {" ".join(f"WHEN '{c}' THEN {c}" for c in ON)} END AS value
              FROM m JOIN f ON f.service = m.service AND f.period_start <= m.d
              CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in FORECAST_COLUMNS)}) AS v(method)),
            t AS (SELECT service, label, d, method, sum(value) AS total FROM c GROUP BY ALL)
            SELECT service, label, d AS milestone_date, method, round(coalesce(total, 0), 3) AS total FROM t""",
        "forecast_horizon_30": f"""{all_methods(*daily)}
            SELECT service, period_start, CAST(NULL AS DOUBLE) AS cost, {column_list()} FROM f WHERE h <= 30""",
        "budget_amounts": """SELECT n_name AS "BudgetName",
            CASE WHEN n_regionkey > 0 THEN CAST(n_nationkey * 10.5 AS DOUBLE) ELSE 0 END AS "BudgetAmount" FROM nation""",
        "budget_all": budget_sql(),
        "budget_single": budget_sql(where="BudgetName = 'ASIA'"),
        "budget_status_counts": f"""SELECT "BudgetName", "Status", count(*) AS row_count FROM ({budget_sql()}) GROUP BY 1, 2""",
        "budget_alerts": f"""SELECT *, printf('  - %s: %.2f vs %.2f (%.1f%% variance)', "BudgetName", "ActualCost",
            "BudgetAmount", "VariancePercent") AS alert FROM ({budget_sql()}) WHERE "Status" IN ('THRESHOLD_BREACH', 'OVER_BUDGET')""",
        "budget_by_dimension": f"""WITH m AS (SELECT date_trunc('month', period_start)::DATE AS d, service, sum(cost) AS c
              FROM ({SERVICE_DAILY}) GROUP BY 1, 2), b AS (SELECT *, length(service) * 5000.0::DOUBLE AS a FROM m)
            SELECT d AS "PeriodStart", service AS "BudgetName", a AS "BudgetAmount", round(c, 4) AS "ActualCost",
              round(a - c, 6) AS "Variance", round((c - a) / a * 100, 6) AS "VariancePercent",
              CASE WHEN c / a * 100 >= 100 THEN 'OVER_BUDGET' WHEN c / a * 100 >= 80 THEN 'THRESHOLD_BREACH'
              ELSE 'UNDER_BUDGET' END AS "Status" FROM b""",
        "budget_many_status": f"""WITH b AS (SELECT (p_retailprice * k * 2)::DOUBLE AS a FROM part, unnest(range(6)) AS u(k))
            SELECT period_start AS "PeriodStart", CASE WHEN a = 0 THEN 'NO_BUDGET' WHEN cost / nullif(a, 0) * 100 >= 100 THEN
              'OVER_BUDGET' WHEN cost / nullif(a, 0) * 100 >= 80 THEN 'THRESHOLD_BREACH' ELSE 'UNDER_BUDGET' END AS "Status",
              count(*) AS row_count FROM ({SERVICE_DAILY}) CROSS JOIN b GROUP BY 1, 2""",
        "budget_missing_cost": budget_sql(
            f"""SELECT service, period_start, CASE WHEN service <> 'error' THEN cost END AS cost FROM ({SERVICE_DAILY})"""
        ),
        "budget_json_rows": budget_sql(),
        "anomaly_rolling_sma": anomaly_sql(LINE_DAILY, ROLLING_SMA),
        "anomaly_rolling_es": anomaly_sql(LINE_DAILY, ROLLING_ES),
        "anomaly_periods": anomaly_sql(recent, f"{ROLLING_SMA} UNION ALL {ROLLING_ES}", "group_key", "n >= 10"),
        "percent_diff": f"""WITH s AS ({LINE_DAILY}) SELECT a.service, a.period_start,
            round((a.cost - b.cost) / nullif(b.cost, 0) * 100, 4) AS change_pct
            FROM s a LEFT JOIN s b ON a.service = b.service AND b.period_start = a.period_start - 7""",
        "step_change_pct": event_sql(SERVICE_DAILY, "2024-01-11", "later", "cost * CAST(1.25 AS DOUBLE)"),
        "step_change_value": event_sql(LINE_DAILY, "1998-03-01", "later", "cost - 250000"),
        "spike_pct": event_sql(LINE_DAILY, "1998-03-01", "later AND r <= 14", "cost * CAST(1.5 AS DOUBLE)"),
        "spike_value": event_sql(MONTHLY, "1998-03-15", "later AND r <= 5", "cost + CAST(1234.5 AS DOUBLE)"),
        "deep_pct": event_sql(LINE_DAILY, "1999-12-25", "later AND r <= 10", "cost * CAST(0.7 AS DOUBLE)"),
        "deep_value_clamped": event_sql(
            """SELECT l_returnflag AS service, CAST(l_shipdate AS DATE) AS period_start,
            round(sum(l_extendedprice - 38000), 6) AS cost FROM lineitem GROUP BY 1, 2""",
            "1998-01-01",
            "later AND r <= 30",
            "cost - 50000",
        ),
        "event_note": f"""SELECT service, period_start, round(cost * CASE WHEN r BETWEEN 1 AND 3 THEN CAST(1.5 AS DOUBLE)
            ELSE 1 END, 6) AS cost, CASE WHEN r = 1 THEN 'launch' ELSE '' END AS note FROM (SELECT *,
            CASE WHEN period_start >= DATE '2024-01-15' THEN row_number() OVER (PARTITION BY service,
            period_start >= DATE '2024-01-15' ORDER BY period_start) END AS r FROM ({SERVICE_DAILY}))""",
        "event_note_append": f"""SELECT service, period_start, round(CASE WHEN q IS NOT NULL THEN cost * CAST(1.5 AS DOUBLE)
            WHEN r <= 2 THEN greatest(cost - 10, 0) ELSE cost END, 6) AS cost,
            CASE WHEN r = 1 THEN 'launch' || chr(10) || 'outage' WHEN q = 1 THEN 'new price' ELSE '' END AS note
            FROM (SELECT *, CASE WHEN period_start >= DATE '2024-01-15' THEN row_number() OVER (PARTITION BY service,
              period_start >= DATE '2024-01-15' ORDER BY period_start) END AS r,
              CASE WHEN period_start >= DATE '2024-01-20' THEN row_number() OVER (PARTITION BY service,
              period_start >= DATE '2024-01-20' ORDER BY period_start) END AS q FROM ({SERVICE_DAILY}))""",
        "seasonality_toys": season_sql(MONTH_FACTORS["toys"]),
        "seasonality_holidays": season_sql(MONTH_FACTORS["holidays"]),
        "seasonality_custom": season_sql([1, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2, 0]),
        "random_spikes": f"""SELECT service, period_start, round(CASE WHEN {uniform('hit', draw)} < 0.2
            THEN cost * (1 + {uniform('size', draw)} * CAST(0.4 AS DOUBLE)) ELSE cost END, 4) AS cost FROM ({LINE_DAILY})""",
        "gen_dates": f"""SELECT 'monthly' AS kind, d AS day, CAST(CASE WHEN day(d) = 1 THEN d
              ELSE date_trunc('month', d) + INTERVAL 1 MONTH END + to_months(CAST(i AS INTEGER)) AS DATE) AS period_start
            FROM (SELECT d, unnest(generate_series(0, 5)) AS i FROM ({ORDER_DAYS}))
            UNION ALL SELECT 'daily', d, d - CAST(i AS INTEGER)
            FROM (SELECT d, unnest(generate_series(0, 5)) AS i FROM ({ORDER_DAYS}))""",
        "gen_upward": generated("baseline + trend * i"),
        "gen_downward": generated("baseline - 75.0 * i"),
        "gen_step": generated("baseline + CASE WHEN i >= 18 THEN 50 ELSE 0 END", grain="monthly"),
        "gen_spike": generated("baseline + CASE WHEN i = 6 THEN 100 ELSE 0 END", periods=20),
        "gen_flat": generated("baseline"),
        "gen_noise": generated(f"baseline * (1 + CAST(0.1 AS DOUBLE) * {noise})"),
    }
    queries["milestone_text"] = f"""SELECT service, label, milestone_date, method,
        printf('%s (%s): %s: %.2f', label, CAST(milestone_date AS VARCHAR), method, total) AS line
        FROM ({queries["milestone_summary"]}) WHERE method = 'sma'"""
    queries["anomaly_text"] = f"""SELECT group_key AS "Group", method AS "Method", period AS "Period",
        coalesce(CAST(change_pct AS VARCHAR), 'N/A') AS "Change (%)", anomaly AS "Anomaly" FROM ({queries["anomaly_periods"]})"""
    return queries
