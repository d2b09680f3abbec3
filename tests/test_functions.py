import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import at, money, rows
from tillbook.functions import dates, labels, numbers, predicates


def values(spark, expression, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


SEASONS = [
    # start, end, day, in season
    (None, "2024-03-01", "2025-07-01", True),
    ("2024-03-01", None, "2025-07-01", True),
    ("2024-03-01", "2024-05-31", "2025-04-15", True),
    ("2024-03-01", "2024-05-31", "2025-03-01", True),
    ("2024-03-01", "2024-05-31", "2025-05-31", True),
    ("2024-03-01", "2024-05-31", "2025-02-28", False),
    ("2024-03-01", "2024-05-31", "2025-06-01", False),
    ("2024-11-01", "2025-02-28", "2030-12-15", True),
    ("2024-11-01", "2025-02-28", "2030-02-28", True),
    ("2024-11-01", "2025-02-28", "2030-03-01", False),
    ("2024-11-01", "2025-02-28", "2030-10-31", False),
    ("2024-03-20", "2024-03-05", "2025-03-25", False),
    ("2024-03-20", "2024-03-05", "2025-03-01", False),
]


@pytest.mark.parametrize("start,end,day,expected", SEASONS)
def test_in_season(spark, start, end, day, expected):
    df = spark.createDataFrame([(start and at(start), end and at(end))], "s timestamp_ntz, e timestamp_ntz")
    assert rows(df.select(predicates.in_season("s", "e", dt.date.fromisoformat(day)))) == [(expected,)]
    with_column = df.withColumn("day", F.lit(day).cast("date"))
    assert rows(with_column.select(predicates.in_season("s", "e", F.col("day")))) == [(expected,)]


def season_by_hand(start, end, day):
    if start is None or end is None:
        return True
    start, end, day = ((d.month, d.day) for d in (start, end, day))
    if end[0] < start[0]:
        return day >= start or day <= end
    return start <= day <= end


def test_in_season_on_a_grid_of_dates(spark):
    grid = [None] + [dt.date(2024, month, day) for month in (1, 2, 3, 6, 11, 12) for day in (1, 15, 29)]
    triples = [(s, e, d) for s in grid for e in grid for d in grid if d]
    df = spark.createDataFrame(triples, "s date, e date, d date")
    found = rows(df.select("s", "e", "d", predicates.in_season("s", "e", F.col("d"))))
    assert [r[3] for r in found] == [season_by_hand(*r[:3]) for r in found]


def test_ranges_differ_at_the_last_midnight(spark):
    times = [at("2025-06-23"), at("2025-06-24T23:59:59"), at("2025-06-25"), at("2025-06-22T23:59:59")]
    span = dt.date(2025, 6, 23), dt.date(2025, 6, 24)
    half_open = values(spark, predicates.in_day_range("v", *span), times, "timestamp_ntz")
    closed = values(spark, predicates.in_closed_range("v", *span), times, "timestamp_ntz")
    assert half_open == [True, True, False, False]
    assert closed == [True, True, True, False]


def test_ranges_do_not_depend_on_the_session_zone(spark, conf):
    conf(spark__sql__session__timeZone="America/New_York")
    times = [at("2025-06-23"), at("2025-06-23T23:59:59"), at("2025-06-24")]
    assert values(spark, predicates.on_day("v", dt.date(2025, 6, 23)), times, "timestamp_ntz") == [True, True, False]


def test_iso_week_ignores_the_year(spark):
    times = [at("2024-06-24"), at("2025-06-23"), at("2024-12-30"), at("2025-06-30")]
    assert values(spark, dates.iso_week("v"), times, "timestamp_ntz") == [26, 26, 1, 27]
    assert values(spark, predicates.in_iso_week("v", 26), times, "timestamp_ntz") == [True, True, False, False]


def test_check_range():
    day = dt.date(2025, 1, 2)
    for bounds in [(None, day), (day, None)]:
        with pytest.raises(ValueError):
            predicates.check_range(*bounds)
    predicates.check_range(day, day - predicates.ONE_DAY)
    with pytest.raises(ValueError):
        predicates.check_range(day, day - predicates.ONE_DAY, ordered=True)


def test_small_predicates(spark):
    totals = [money("-1"), money("0"), money("2"), None]
    assert values(spark, predicates.is_return("v"), totals, "decimal(18,2)") == [True, False, False, None]
    assert values(spark, predicates.is_void("v"), totals, "decimal(18,2)") == [False, True, False, None]
    assert values(spark, predicates.has_pending_restock("v"), [1, 0, -1], "int") == [True, False, False]
    assert values(spark, predicates.needs_restock("v", F.lit(5)), [4, 5, 6, None], "int") == ["Y", "Y", "N", "Y"]
    duty = predicates.is_rotation_cashier(F.lit("Cashier"), "v", (2, 3))
    assert values(spark, duty, [1, 2, 3], "int") == [False, True, True]
    assert values(spark, predicates.in_category("v", "Tea"), ["Tea", "tea"]) == [True, False]


def test_normalise_date(spark):
    texts = [
        "2025 03 04", "2025/03/04", " 2025-03-04 ", "2025-02-30", "2024-02-31", "2025-04-31", "2025-13-01",
        "2025-01-32", "2025-01-00", "", "  ", None, "2025-2-3", "2025-03/04", "04.03.2025", "2025-03-04x", "0000-01-01",
    ]
    day = dt.date(2025, 3, 4)
    assert values(spark, dates.normalise_date("v"), texts) == [
        day, day, day, dt.date(2025, 2, 28), dt.date(2024, 2, 29), dt.date(2025, 4, 30), None,
        None, None, None, None, None, None, None, None, None, None,
    ]


def test_iso_date_is_strict(spark):
    texts = ["2025-03-04", "2025-02-30", "2025/03/04", "2025-3-4", "", None]
    assert values(spark, dates.iso_date("v"), texts) == [dt.date(2025, 3, 4), None, None, None, None, None]


def test_feed_timestamps(spark):
    texts = ["1/1/2025 0:00", "12/31/2025 23:59", "2024-07-01 08:05:00", None]
    assert values(spark, dates.parse_feed_timestamp("v"), texts) == [
        at("2025-01-01"), at("2025-12-31T23:59:00"), at("2024-07-01T08:05:00"), None,
    ]
    for bad in ["soon", "13/45/2025 0:00"]:
        with pytest.raises(PySparkException):
            values(spark, dates.parse_feed_timestamp("v"), [bad])


def test_day_arithmetic(spark):
    assert dates.add_days(dt.date(2025, 3, 1), -1) == dt.date(2025, 2, 28)
    assert dates.usage_window(dt.date(2025, 3, 8)) == (dt.date(2025, 3, 1), dt.date(2025, 3, 8))
    day = dt.date(2024, 12, 25)
    assert values(spark, dates.month_day("v"), [day], "date") == [1225]
    assert values(spark, dates.add_days("v", 7), [day], "date") == [dt.date(2025, 1, 1)]


def test_labels(spark):
    amounts = [money("1234.50"), money("-1234.50"), money("0.13"), money("0.00")]
    assert values(spark, labels.money_label("v"), amounts, "decimal(18,2)") == [
        "$1,234.50", "$-1,234.50", "$0.13", "$0.00",
    ]
    assert values(spark, labels.money_label("v"), [0.125, 0.375], "double") == ["$0.13", "$0.38"]
    assert values(spark, labels.hour_label("v"), [7, 21], "int") == ["07:00", "21:00"]
    assert values(spark, labels.time_label("v"), [at("2025-06-23T09:15:00"), at("2025-06-23T09:15:00.25"), None], "timestamp_ntz") == [
        "2025-06-23 09:15:00.0", "2025-06-23 09:15:00.25", "None",
    ]
    assert values(spark, labels.items_label("v"), [12], "bigint") == ["Discards: 12 items"]
    assert values(spark, labels.total_label("v"), [money("12.5")], "decimal(18,2)") == ["Total: $12.50"]
    assert values(spark, labels.weekday_label("v"), [at("2025-06-23"), at("2025-06-25")], "timestamp_ntz") == [
        "Monday   ", "Wednesday",
    ]
    assert values(spark, labels.day_month_label("v"), [dt.date(2025, 6, 3), dt.date(2025, 9, 12)], "date") == [
        "03 June     ", "12 September",
    ]
    assert values(spark, labels.unit_label("v", F.lit("oz")), ["Mint", None]) == ["Mint (oz)", "null (oz)"]
    assert values(spark, labels.unit_label("v", F.lit(None).cast("string")), ["Mint"]) == ["Mint (null)"]
    assert values(spark, labels.line_label("v", F.lit(4.5)), ["Tea []"]) == ["Tea [] - $4.50"]
    assert values(spark, labels.label_price("v"), ["Tea [] - $4.50", "$ave - $1.00", "Tea - $x"]) == [
        money("4.50"), money("1.00"), None,
    ]
    assert values(spark, labels.trimmed("v"), ["  a b\t ", ""]) == ["a b", ""]


def test_numbers(spark):
    assert values(spark, numbers.to_int("v"), ["12", "-3", "+4", "1.0", " 5", "x", "", None, "99999999999"]) == [
        12, -3, 4, None, None, None, None, None, None,
    ]
    assert values(spark, numbers.to_money("v"), ["12", " 4.5 ", "1.005", "1e2", "x", "", None]) == [
        money("12.00"), money("4.50"), money("1.01"), money("100.00"), None, None, None,
    ]
    halves = [money("0.125"), money("-0.125"), money("2.675")]
    assert values(spark, numbers.round2("v"), halves, "decimal(10,3)") == [money("0.13"), money("-0.13"), money("2.68")]
    assert values(spark, numbers.truncate_cents("v"), [money("5.999"), money("-5.999"), money("0.29")], "decimal(10,3)") == [
        money("5.99"), money("-5.99"), money("0.29"),
    ]


def test_aggregates_on_nothing_and_on_nulls(spark):
    stats = [
        F.count("*"), F.count("v"), F.sum("v"), numbers.sum0("v"), numbers.avg2("v"),
        numbers.sum_if(F.col("v") < 0, "v"), numbers.count_if(F.col("v") == 0),
    ]
    schema = "i int, v decimal(18,2)"
    empty = spark.createDataFrame([], schema)
    assert rows(empty.agg(*stats)) == [(0, 0, None, money("0"), None, money("0"), 0)]
    some = spark.createDataFrame([(1, money("1.00")), (2, None), (3, money("-2.00")), (4, money("0"))], schema)
    assert rows(some.agg(*stats)) == [
        (4, 3, money("-1.00"), money("-1.00"), money("-0.33"), money("-2.00"), 1),
    ]


def test_average_rounds_once(spark):
    # 10.00499999... must not pass through 10.005.
    df = spark.createDataFrame([(money("20009999.99"), 2000000)], "s decimal(28,2), n bigint")
    assert rows(df.select(numbers.average2("s", "n"))) == [(money("10.00"),)]
    df = spark.createDataFrame([(money("20010000.00"), 2000000)], "s decimal(28,2), n bigint")
    assert rows(df.select(numbers.average2("s", "n"))) == [(money("10.01"),)]
