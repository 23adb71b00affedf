"""Forecast methods against fixed expectations and recovery tests."""

import math

import numpy as np
import pytest
from helpers import NAMES, day, days_from, months_from
from pyspark.sql import functions as F

from spendframe.operators import clean, combine, spine
from spendframe.operators.forecast import ForecastOptions, fit, forecast_rows, forecast_table, numeric, sparse_trend
from spendframe.operators.forecast import closed_forms as cf
from spendframe.operators.forecast import trees
from spendframe.params import FORECAST_COLUMNS
from spendframe.plans import forecast_report

BLEND = ForecastOptions(ensemble=True)


def forecast(df, options=BLEND, **names):
    return forecast_rows(df, options, **{**NAMES, **names}).orderBy("step").collect()


def short(**settings):
    return ForecastOptions(min_points=1, **settings)


DAILY_EXPECTED = dict(sma=62, es=66.0, hw=(91.128926, 112.574280, 1676.011113), theta=(72, 800), ens=(72.782232, 651.002778))
MISSING_EXPECTED = dict(
    sma=62, es=65.998778, hw=(49.807554, 62.149551, 1521.661644), theta=(70.356923, 928.276923), ens=(62.040814, 644.484336)
)
MONTHLY_EXPECTED = dict(sma=360, es=380.0, hw=(470.995750, 586.511480, 586.511480), theta=(410, 520), ens=(405.248937, 461.627870))


def check(rows, wanted):
    near = lambda x: pytest.approx(x, abs=2e-6)
    assert rows[0].sma == near(wanted["sma"]) and rows[-1].sma == near(wanted["sma"])
    assert rows[0].es == near(wanted["es"])
    assert (rows[0].hw, rows[11].hw, rows[-1].hw) == tuple(map(near, wanted["hw"]))
    assert (rows[0].theta, rows[-1].theta) == tuple(map(near, wanted["theta"]))
    assert (rows[0].ensemble, rows[-1].ensemble) == tuple(map(near, wanted["ens"]))


def test_daily_series(daily_30):
    rows = forecast(daily_30)
    assert len(rows) == 365
    assert (rows[0].PeriodStart, rows[-1].PeriodStart) == (day("2025-01-31"), day("2026-01-30"))
    check(rows, DAILY_EXPECTED)


def test_row_order_does_not_matter(series):
    pairs = list(zip(days_from("2025-01-01", 30), [10 + 2 * i for i in range(30)]))
    mixed = [pairs[14], *pairs[:1], pairs[2], pairs[1], *pairs[3:14], *pairs[15:]]
    check(forecast(series(*zip(*mixed)).repartition(5)), DAILY_EXPECTED)


def test_missing_values_are_dropped(spark):
    text = {1: "", 6: "", 18: "", 3: "NaN", 15: "NaN"}
    raw = [(str(d), text.get(i, str(10 + 2 * i))) for i, d in enumerate(days_from("2025-01-01", 30))]
    df = clean.clean_series(spark.createDataFrame(raw, "PeriodStart string, Cost string"), **NAMES)
    assert df.count() == 25
    check(forecast(df), MISSING_EXPECTED)


def test_monthly_series(monthly_30):
    rows = forecast(monthly_30)
    assert [r.PeriodStart for r in rows] == months_from("2026-07-01", 12)
    check(rows, MONTHLY_EXPECTED)


MILESTONES = {
    "daily": [
        ("2025-01-31", 62.00, 66.00, 91.13, 72.00, 72.78),
        ("2025-02-28", 1798.00, 1914.00, 3929.31, 2900.00, 2635.33),
        ("2025-03-31", 3720.00, 3960.00, 10532.07, 7860.00, 6518.02),
        ("2025-06-30", 9362.00, 9966.00, 47889.45, 33522.00, 25184.86),
        ("2025-12-31", 20770.00, 22110.00, 197977.71, 136010.00, 94216.93),
    ],
    "monthly": [
        ("2026-06-30", 0, 0, 0, 0, 0),
        ("2026-07-31", 360.00, 380.00, 471.00, 410.00, 405.25),
        ("2026-06-30", 0, 0, 0, 0, 0),
        ("2026-09-30", 1080.00, 1140.00, 1548.05, 1260.00, 1257.01),
        ("2026-12-31", 2160.00, 2280.00, 3532.82, 2610.00, 2645.70),
    ],
}


@pytest.mark.parametrize("kind", ["daily", "monthly"])
def test_milestone_sums(kind, daily_30, monthly_30):
    df = daily_30 if kind == "daily" else monthly_30
    _, sums = forecast_report(df, BLEND, milestones=True, **NAMES)
    got = {(r.label, r.method): (r.milestone_date, r.total) for r in sums.collect()}
    assert {m for _, m in got} == {"sma", "es", "hw", "arima", "sarima", "theta", "prophet", "ensemble"}
    labels = [label for label, _ in spine.milestone_days(F.lit("2025-01-01").cast("date"))]
    for label, (end, *totals) in zip(labels, MILESTONES[kind], strict=True):
        for method, total in zip(("sma", "es", "hw", "theta", "ensemble"), totals, strict=True):
            assert got[label, method] == (day(end), pytest.approx(total, abs=0.0051))
        assert got[label, "arima"][1] == 0.0
    line = combine.milestone_lines(sums).filter("method = 'sma' and label = 'end_of_this_month'").first().line
    assert line.startswith("end_of_this_month (") and ": sma: " in line


def test_small_inputs(series):
    five = series(days_from("2025-01-01", 5), [10, 20, 30, 40, 50])
    assert forecast(five, short(sma_window=3))[0].sma == 40.0
    assert forecast(five, short(es_alpha=0.3))[0].es == pytest.approx(32.269)
    assert forecast(five, short())[0].hw == pytest.approx(32.269)  # too short: smoothing with the hw alpha
    one = series(days_from("2025-01-01", 1), [10])
    assert [r.theta for r in forecast(one, short())][:2] == [10.0, 10.0]
    assert forecast(one, short())[0].PeriodStart.day == 1  # a lone first of month counts as monthly


def test_holt_winters_two_seasons(series):
    values = [*range(100, 211, 10), *range(105, 216, 10)]
    rows = forecast(series(days_from("2025-01-01", 24), values))
    assert (rows[0].hw, rows[11].hw) == (pytest.approx(103.816506, abs=1e-6), pytest.approx(220.577783, abs=1e-6))
    half = forecast(series(days_from("2025-01-01", 12), [*range(100, 151, 10), *range(105, 156, 10)]), short(hw_seasonal_periods=6))
    assert all(math.isfinite(r.hw) for r in half)


def test_holt_winters_zero_level_is_missing(series):
    rows = forecast(series(days_from("2025-01-01", 30), [0] * 30))
    assert rows[0].hw is None and rows[0].sma == 0.0 and rows[0].ensemble == 0.0


def plain_holt_winters(v, a, b, g, m, steps):
    level, trend = np.mean(v[:m]), (np.mean(v[m : 2 * m]) - np.mean(v[:m])) / m
    seasons = [x / level for x in v[:m]]
    for i in range(m, len(v)):
        new = a * v[i] / seasons[i - m] + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        seasons.append(g * v[i] / new + (1 - g) * seasons[i - m])
        level = new
    return [(level + h * trend) * seasons[-m:][(h - 1) % m] for h in range(1, steps + 1)]


def test_holt_winters_batch_equals_plain_recursion():
    rng = np.random.default_rng(3)
    batch = [rng.uniform(1, 9, size=n) for n in (29, 24, 90, 25, 60)]
    order = sorted(range(5), key=lambda i: -len(batch[i]))
    level, trend, season = numeric._holt_winters([batch[i] for i in order], 0.3, 0.1, 0.1, 12)
    for row, i in enumerate(order):
        got = [(level[row] + h * trend[row]) * season[row][(h - 1) % 12] for h in range(1, 31)]
        assert got == pytest.approx(plain_holt_winters(batch[i], 0.3, 0.1, 0.1, 12, 30))


def test_blocks_cover_every_series(monkeypatch):
    monkeypatch.setattr(numeric, "_MATRIX_CELLS", 50)
    series = [np.zeros(n) for n in (5, 80, 30, 7, 7, 1)]
    blocks = list(numeric._blocks(series))
    assert sorted(i for b in blocks for i in b) == list(range(6)) and len(blocks) > 2


def test_table_has_all_columns_and_keeps_repeated_dates(series):
    df = series([*days_from("2025-01-01", 12), day("2025-01-05")], [*range(12), 99])
    table = forecast_table(df, BLEND, **NAMES)
    assert table.columns == ["PeriodStart", "Cost", *FORECAST_COLUMNS]
    rows = table.collect()
    past = [r for r in rows if r.Cost is not None]
    assert len(past) == 13 and len(rows) == 13 + 365
    assert all(r[c] is None for r in past for c in FORECAST_COLUMNS)
    assert all(r.arima is None and r.ensemble is not None for r in rows if r.Cost is None)


def test_length_gate(series):
    assert forecast(series(days_from("2025-01-01", 9), range(9))) == []
    assert len(forecast(series(days_from("2025-01-01", 10), range(10)))) == 365
    nine = series(days_from("2025-01-01", 9), range(9))
    assert forecast_table(nine, **NAMES).count() == 0
    assert clean.skipped_series(nine, series_cols=[]).first().row_count == 9


def test_two_series_together_equal_each_alone(daily_30, series):
    other = series(days_from("2025-03-01", 40), [5 + (i % 7) for i in range(40)])
    both = daily_30.withColumn("g", F.lit("a")).unionByName(other.withColumn("g", F.lit("b")))
    options = ForecastOptions(methods=("sma", "es", "hw", "theta", "arima", "prophet"), ensemble=True)
    together = forecast_rows(both, options, series_cols=["g"], **NAMES)
    for name, alone in (("a", daily_30), ("b", other)):
        got = together.filter(F.col("g") == name).drop("g").orderBy("step").collect()
        for x, y in zip(got, forecast(alone, options), strict=True):
            assert [x[c] for c in ("PeriodStart", *options.methods)] == pytest.approx(
                [y[c] for c in ("PeriodStart", *options.methods)]
            )


def test_results_do_not_depend_on_shuffle_width(spark, daily_30):
    def run(width):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        return forecast(daily_30.repartition(width))

    try:
        narrow, wide = run(1), run(9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for a, b in zip(narrow, wide, strict=True):
        assert a.asDict() == pytest.approx(b.asDict())


@pytest.mark.parametrize(
    "frequency, grain",
    [("ME", "monthly"), ("MS", "monthly"), ("QE", "daily"), ("2ME", "daily"), ("BME", "daily"), ("D", "daily"), ("W", "daily")],
)
def test_grain(spark, frequency, grain):
    import pandas as pd

    dates = [(d.date(),) for d in pd.date_range("2024-01-15", periods=14, freq=frequency)]
    spans = spine.series_spans(spark.createDataFrame(dates, "d date"), series_cols=[], date_col="d")
    assert spans.first().grain == grain


def test_repeated_or_gapped_month_ends_are_daily(spark):
    for text in ("2024-01-31 2024-01-31 2024-03-31", "2024-01-31 2024-02-29 2024-04-30 2024-05-31"):
        df = spark.createDataFrame([(day(d),) for d in text.split()], "d date")
        assert spine.series_spans(df, series_cols=[], date_col="d").first().grain == "daily"


def test_forecast_dates(spark):
    for grain, count, first, last in (("daily", 365, "2024-01-02", "2024-12-31"), ("monthly", 12, "2024-02-01", "2025-01-01")):
        span = spark.createDataFrame([(day("2024-01-01"), grain)], "last_date date, grain string")
        rows = spine.forecast_dates(span, series_cols=[], date_col="d").orderBy("step").collect()
        assert (len(rows), rows[0].d, rows[-1].d) == (count, day(first), day(last))


def test_constant_guard(series):
    on = ForecastOptions(methods=("neural_prophet",))
    flat = series(days_from("2025-01-01", 12), [100 + 0.0001 * (i % 2) for i in range(12)])
    assert forecast(flat, on)[0].neural_prophet == pytest.approx(100.0001)
    bumpy = series(days_from("2025-01-01", 12), [100 + 0.1 * (i % 2) for i in range(12)])
    assert forecast(bumpy, ForecastOptions(methods=("neural_prophet",), network_trained=False))[0].neural_prophet is None
    trained = [r.neural_prophet for r in forecast(bumpy, on)]
    assert all(v == pytest.approx(100.05, abs=1) for v in trained[:30]) and len(set(trained)) > 1


def test_options_are_checked():
    for bad in ({"methods": ("nope",)}, {"es_alpha": 1.5}, {"sma_window": 0}, {"arima_order": "1,1"}):
        with pytest.raises(ValueError):
            ForecastOptions(**bad)
    with pytest.warns(UserWarning):
        assert ForecastOptions(darts_algorithm="nope").darts_family == "smoothing"
    assert ForecastOptions(darts_algorithm="theta").methods[-1] == "darts"


# -- least-squares models ---------------------------------------------------------------------


def test_noiseless_autoregression_is_recovered():
    steps = [1.0]
    for _ in range(59):
        steps.append(0.6 * steps[-1])
    values = np.cumsum([50.0, *steps])
    future = values[-1] + np.cumsum(steps[-1] * 0.6 ** np.arange(1, 21))
    assert numeric.seasonal_arima(values, 20, (1, 1, 0), (0, 0, 0, 1)) == pytest.approx(future, abs=1e-6)


def test_closed_form_ar1_equals_model(spark, series):
    rng = np.random.default_rng(5)
    values = np.round(np.cumsum(rng.normal(size=60)) + 100, 3)
    df = series(days_from("2025-01-01", 60), values)
    got = forecast(df, ForecastOptions(methods=("arima",), arima_order=(1, 1, 0), arma_estimator="least_squares"))
    state = cf.ar1_difference_state(df, series_cols=[], **NAMES)
    steps = state.select("*", F.explode(F.sequence(F.lit(1), F.lit(365))).alias("step"))
    exact = [r.v for r in steps.select("step", cf.ar1_difference_value(F.col("step")).alias("v")).orderBy("step").collect()]
    assert [r.arima for r in got] == pytest.approx(exact, abs=1e-6)


def test_seasonal_naive_is_a_special_case(series):
    values = [10 * (i % 12) + i for i in range(36)]
    options = ForecastOptions(methods=("sarima",), sarima_order=(0, 0, 0), sarima_seasonal_order=(0, 1, 0, 12))
    rows = forecast(series(months_from("2022-01-01", 36), values), options)
    assert [r.sarima for r in rows] == pytest.approx(values[-12:])


def test_moving_average_part_beats_the_mean():
    rng = np.random.default_rng(8)
    noise = rng.normal(size=800)
    values = 20 + noise[1:] + 0.8 * noise[:-1]
    one_step = numeric.seasonal_arima(values, 1, (0, 0, 1), (0, 0, 0, 1))[0]
    assert abs(one_step - (20 + 0.8 * noise[-1])) < 0.35


def test_impossible_fits_are_missing(series):
    options = ForecastOptions(methods=("sma", "sarima"), darts_algorithm="linear_regression", ensemble=True)
    rows = forecast(series(days_from("2025-01-01", 11), range(11)), options)
    assert len(rows) == 365 and rows[0].sarima is None and rows[0].darts is None
    assert rows[0].ensemble == rows[0].sma


def test_sinusoid_is_recovered_without_penalty():
    days = np.arange(19_000, 19_000 + 900)
    wave = lambda d: 50 + 7 * np.sin(2 * np.pi * d / 365.25) + 3 * np.cos(4 * np.pi * d / 365.25)
    future = np.arange(days[-1] + 1, days[-1] + 366)
    settings = sparse_trend.Settings(changepoint_scale=math.inf, season_scale=math.inf)
    got = sparse_trend.fit([wave(days)], [days], settings)[0].at(future, settings)
    assert got == pytest.approx(wave(future), abs=1e-6)


def test_yearly_terms_need_a_year(daily_30):
    rows = forecast(daily_30, ForecastOptions(methods=("prophet",)))
    assert rows[0].prophet == pytest.approx(70, abs=1.5) and rows[29].prophet == pytest.approx(128, abs=12)


def test_lag_regression_continues_a_line(daily_30):
    rows = forecast(daily_30, ForecastOptions(methods=(), darts_algorithm="linear_regression"))
    assert [r.darts for r in rows[:5]] == pytest.approx([70, 72, 74, 76, 78])


def test_auto_order_continues_a_line(daily_30):
    rows = forecast(daily_30, ForecastOptions(methods=(), darts_algorithm="auto_arima"))
    assert [r.darts for r in rows[:3]] == pytest.approx([70, 72, 74], abs=0.5)


@pytest.mark.parametrize("name, column", [("theta", "theta"), ("arima", "arima")])
def test_lag_model_names_share_families(daily_30, name, column):
    options = ForecastOptions(methods=("hw", "theta", "arima"), darts_algorithm=name)
    assert all(r.darts == r[column] for r in forecast(daily_30, options))


@pytest.mark.parametrize("name", ["random_forest", "xgboost"])
def test_tree_models(series, name):
    values = [100 + 40 * ((i % 12) in (10, 11)) for i in range(60)]
    df = series(months_from("2020-01-01", 60), values)
    rows = forecast(df, ForecastOptions(methods=(), darts_algorithm=name))
    assert [r.darts for r in rows] == pytest.approx(values[-12:], abs=12)


def test_lag_features(daily_30):
    rows = trees.lag_features(daily_30, series_cols=[], lags=3, **NAMES).orderBy("PeriodStart").collect()
    assert len(rows) == 27 and (rows[0].Cost, rows[0].lag_1, rows[0].lag_3) == (16.0, 14.0, 10.0)


def test_horizon_filter(spark):
    rows = [(d, 1.0 if i >= 5 else None, None) for i, d in enumerate(days_from("2025-01-01", 10))]
    table = spark.createDataFrame(rows, "PeriodStart date, sma double, es double")
    kept = combine.forecast_horizon(table, 3, date_col="PeriodStart").orderBy("PeriodStart").collect()
    assert [r.PeriodStart for r in kept] == days_from("2025-01-06", 3)
    with pytest.raises(ValueError):
        combine.forecast_horizon(table.select("PeriodStart"), 3, date_col="PeriodStart")


def test_long_form_keeps_missing(spark):
    table = spark.createDataFrame([(day("2025-01-01"), 1.0, None)], "PeriodStart date, sma double, es double")
    got = {r.method: r.value for r in combine.forecast_long(table, date_col="PeriodStart").collect()}
    assert got == {"sma": 1.0, "es": None}


def test_fit_keeps_one_row_per_series(daily_30):
    row = fit(daily_30, **NAMES).first()
    assert (row.last_date, row.grain, row.row_count) == (day("2025-01-30"), "daily", 30)
