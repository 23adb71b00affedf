"""What-if events and generated series."""

from functools import partial

import pytest
from helpers import NAMES, costs, day, days_from, months_from
from pyspark.sql import functions as F

from spendframe.operators import clean, events, generate
from spendframe.plans import what_if


def notes(df):
    return [r.note for r in df.orderBy("PeriodStart").collect()]


def test_step_change(flat_ten):
    assert costs(events.step_change(flat_ten, start="2025-01-06", pct=0.5, **NAMES)) == [100] * 5 + [150] * 5
    assert costs(events.step_change(flat_ten, start="2025-01-04", value=-20, **NAMES)) == [100] * 3 + [80] * 7
    assert costs(events.step_change(flat_ten, start="2025-01-04", value=-120, **NAMES)) == [100] * 3 + [0] * 7


def test_spike_and_dip(flat_ten):
    up = events.spike(flat_ten, start="2025-01-03", length=4, pct=0.25, **NAMES)
    assert costs(up) == [100] * 2 + [125] * 4 + [100] * 4
    down = events.dip(flat_ten, start="2025-01-01", length=3, value=150, **NAMES)
    assert costs(down) == [0] * 3 + [100] * 7


def test_event_length_counts_rows(series):
    gaps = series([day(d) for d in ("2025-01-01", "2025-01-10", "2025-02-01", "2025-03-01")], [10] * 4)
    assert costs(events.spike(gaps, start="2025-01-02", length=2, value=5, **NAMES)) == [10, 15, 15, 10]
    long = events.spike(gaps, start="2025-02-15", length=99, value=5, **NAMES)
    assert costs(long) == [10, 10, 10, 15]


def test_clamp_acts_on_all_rows_and_keeps_missing(series):
    df = series(days_from("2025-01-01", 3), [-5, 10, 20]).withColumn("Cost", F.when(F.col("Cost") < 20, F.col("Cost")))
    assert costs(events.dip(df, start="2025-01-02", length=1, pct=0.5, **NAMES)) == [0, 5, None]
    unclamped = events.change_rows(df, events.from_start("PeriodStart", "2025-01-02"), value_col="Cost", value=1.0)
    assert costs(unclamped) == [-5, 11, None]


def test_notes(series):
    five = series(days_from("2025-01-01", 5), [100] * 5)
    out = events.spike(five, start="2025-01-03", length=2, pct=0.5, note="launch", **NAMES)
    assert costs(out) == [100, 100, 150, 150, 100] and notes(out) == ["", "", "launch", "", ""]
    out = events.step_change(five, start="2025-01-04", pct=0.2, note="price", **NAMES)
    assert costs(out) == [100] * 3 + [120] * 2 and notes(out) == ["", "", "", "price", ""]
    assert "note" not in events.annotate(five, date_col="PeriodStart", start="2025-01-01", note="").columns
    none_hit = events.annotate(five, date_col="PeriodStart", start="2030-01-01", note="x")
    assert notes(none_hit) == [""] * 5


def test_note_is_appended(series):
    ten = series(days_from("2025-01-01", 10), [100] * 10, note=[None] * 5 + ["Existing note"] + ["other"] * 4)
    out = notes(events.annotate(ten, date_col="PeriodStart", start="2025-01-06", note="New context"))
    assert out[5] == "Existing note\nNew context" and out[:5] == [None] * 5 and out[6] == "other"


def test_events_per_series(flat_ten):
    both = flat_ten.withColumn("g", F.lit("a")).unionByName(flat_ten.withColumn("g", F.lit("b")))
    out = events.spike(both, series_cols=["g"], start="2025-01-03", length=1, value=1, note="n", **NAMES)
    assert out.filter("Cost = 101").count() == 2 and out.filter("note = 'n'").count() == 2


def test_event_parameters(flat_ten):
    at = {"start": "2025-01-01", **NAMES}
    for bad in ({}, {"pct": 0.1, "value": 1.0}):
        with pytest.raises(ValueError):
            events.step_change(flat_ten, **at, **bad)
    for bad in ({"pct": -0.1, "length": 1}, {"value": 0.0, "length": 1}, {"value": 1.0, "length": 0}):
        with pytest.raises(ValueError):
            events.spike(flat_ten, **at, **bad)
        with pytest.raises(ValueError):
            events.dip(flat_ten, **at, **bad)
    with pytest.raises(ValueError, match="no rows"):
        events.ensure_event_rows(flat_ten, date_col="PeriodStart", start="2030-01-01")
    assert events.ensure_event_rows(flat_ten, date_col="PeriodStart", start="2025-01-10") is flat_ten
    with pytest.raises(ValueError, match="Nope"):
        events.spike(flat_ten, date_col="PeriodStart", value_col="Nope", start="2025-01-01", length=1, pct=0.1)


def test_seasonality(series):
    year = series(months_from("2025-01-01", 12), [100] * 12)
    toys = costs(events.seasonality(year, preset="toys", **NAMES))
    assert [round(toys[i], 9) for i in (0, 10, 11)] == [95, 130, 140]
    own = costs(events.seasonality(year, preset="toys", factors=[2.0] * 11 + [-1.0], **NAMES))
    assert own == [200] * 11 + [-100]  # factors win, nothing is clamped


def test_random_spikes(series):
    twenty = series(days_from("2025-01-01", 20), [100] * 20)
    always = costs(events.random_spikes(twenty, max_pct=0.10, prob=1.0, seed=1, **NAMES))
    assert all(100 <= v <= 110 for v in always) and max(always) > 100 and len(set(always)) == 20
    assert costs(events.random_spikes(twenty, max_pct=0.5, prob=0.0, **NAMES)) == [100] * 20
    again = costs(events.random_spikes(twenty.repartition(7), max_pct=0.10, prob=1.0, seed=1, **NAMES))
    assert again == always
    assert costs(events.random_spikes(twenty, max_pct=0.10, prob=1.0, seed=2, **NAMES)) != always


def test_what_if_chain(flat_ten):
    out = what_if(
        flat_ten,
        partial(events.seasonality, factors=[2.0] * 12, **NAMES),
        partial(events.spike, start="2025-01-02", length=1, value=5, **NAMES),
        partial(events.step_change, start="2025-01-10", pct=-0.5, **NAMES),
    )
    assert costs(out) == [200, 205] + [200] * 7 + [100]


def test_strict_dates(spark):
    good = spark.createDataFrame([("2025-01-01",)], "d string")
    assert clean.strict_dates(good, date_col="d").first().d == day("2025-01-01")
    bad = spark.createDataFrame([("2025-01-01",), ("x",)], "d string")
    with pytest.raises(Exception, match="invalid date"):
        clean.strict_dates(bad, date_col="d").collect()


@pytest.fixture
def spec(spark):
    return spark.createDataFrame([("s", 10.0)], "series string, baseline double")


def made(spec, pattern, **settings):
    start = F.lit(settings.pop("start", "2025-01-01")).cast("date")
    df = generate.generate_series(spec, series_cols=["series"], pattern=pattern, start=start, **settings)
    return [(r.period_start, r.cost) for r in df.orderBy("period_start").collect()]


def test_patterns(spec):
    def values(pattern, **settings):
        return [v for _, v in made(spec, pattern, periods=6, noise=0.0, **settings)]

    assert values("flat") == [10] * 6
    assert values("upward_trend", trend=-2.0) == [10, 12, 14, 16, 18, 20]
    assert values("downward_trend", trend=4.0) == [10, 6, 2, 0, 0, 0]
    assert values("step_change") == [10, 10, 10, 60, 60, 60]
    assert values("step_change", step_index=5, step_size=1.0) == [10] * 5 + [11]
    assert values("spike") == [10, 10, 110, 10, 10, 10]
    assert values("spike", spike_index=0, spike_size=5.0) == [15] + [10] * 5
    with pytest.raises(ValueError):
        values("seasonal")


def test_flat_generator(spark):
    one = spark.createDataFrame([("s",)], "series string")
    rows = made(one, "flat", periods=10, baseline=100.0, noise=0.0)
    assert rows == list(zip(days_from("2025-01-01", 10), [100.0] * 10))
    noisy = [v for _, v in made(one, "flat")]  # defaults: 36 periods around 100 with 5 % noise
    assert len(noisy) == 36 and len(set(noisy)) == 36 and all(75 < v < 125 for v in noisy)


def test_generated_dates(spec):
    def dates(**settings):
        df = generate.generate_dates(spec, series_cols=["series"], **settings)
        return [r.period_start for r in df.orderBy("period_start").collect()]

    at = lambda text: F.lit(text).cast("date")
    assert dates(grain="monthly", start=at("2025-01-15"), periods=2) == [day("2025-02-01"), day("2025-03-01")]
    assert dates(grain="monthly", end=at("2025-03-01"), periods=3) == months_from("2025-01-01", 3)
    assert dates(end=at("2025-01-10"), periods=3) == days_from("2025-01-08", 3)
    assert dates(start=at("2025-01-01"), end=at("2030-01-01"), periods=2) == days_from("2025-01-01", 2)
    with pytest.raises(ValueError):
        dates(periods=3)
    with pytest.raises(ValueError):
        dates(start=at("2025-01-01"), grain="hourly")


def test_noise(spec):
    noisy = [v for _, v in made(spec, "flat", periods=400, noise=0.2)]
    assert noisy == [v for _, v in made(spec.repartition(3), "flat", periods=400, noise=0.2)]
    assert abs(sum(noisy) / 400 - 10) < 0.5 and min(noisy) >= 0 and len(set(noisy)) > 390
    assert [v for _, v in made(spec, "flat", periods=400, noise=0.2, seed=1)] != noisy
