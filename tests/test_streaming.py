import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, money, rows
from tillbook.plans import reports
from tillbook.streaming import generations, live

CARTS = "order_id bigint, orderDate timestamp_ntz, n_lines int, total decimal(18,2)"


def write_batch(spark, folder, data):
    spark.createDataFrame(data, CARTS).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def intake(spark, shop, tmp_path):
    """Run the intake over what has arrived so far; give its orders as (id, employee, total)."""
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "check"))
    os.makedirs(source)

    def run(data=None, **options):
        if data is not None:
            write_batch(spark, source, data)
        stream = spark.readStream.schema(CARTS).options(**options).parquet(source)
        live.start_intake(stream, shop["ordertest"], shop["employee"], out, checkpoint).awaitTermination()
        found = live.accepted_orders(spark, out)
        return sorted(rows(found.select("orderID", "employeeID", "orderTotal")))

    run.source, run.out, run.checkpoint = source, out, checkpoint
    return run


FIRST, SECOND = at("2025-07-01T10:00:00"), at("2025-07-01T09:30:00")


def test_intake_over_restarts(intake):
    begin = [(1, FIRST, 1, money("4.00")), (2, SECOND, 2, money("5.00")), (3, SECOND, 0, money("0.00"))]
    assert intake(begin) == [(6, 3, money("5.00")), (7, 2, money("4.00"))]
    # Cart 1 arrives once more, twice, with a new one and one that is a month late.
    late = (5, at("2025-06-01T08:00:00"), 1, money("1.00"))
    again = [(1, FIRST, 1, money("4.00"))] * 2 + [(4, FIRST, 1, money("7.00")), late]
    assert intake(again) == [
        (6, 3, money("5.00")), (7, 2, money("4.00")), (8, 3, money("1.00")), (9, 2, money("7.00")),
    ]
    assert len(intake([late, (2, SECOND, 2, money("5.00"))])) == 4


def test_an_id_on_two_days_is_two_orders_in_any_batches(spark, intake):
    cart = (1, FIRST, 1, money("4.00"))
    other = (1, at("2025-07-02T00:10:00"), 1, money("6.00"))
    # In one batch, each of them twice, and then again in a later one.
    assert [r[2] for r in intake([cart, other, other, cart])] == [money("4.00"), money("6.00")]
    assert len(intake([other, cart])) == 2


def test_carts_without_id_or_time_all_stay(intake):
    odd = [(None, FIRST, 1, money("1.00"))] * 2 + [(8, None, 1, money("2.00"))]
    assert [r[2] for r in intake(odd)] == [money("1.00"), money("1.00"), money("2.00")]
    assert len(intake([(None, FIRST, 1, money("1.00")), (8, None, 1, money("2.00"))])) == 4


def test_unordered_micro_batches_lose_nothing(spark, intake):
    times = [at("2025-07-01T00:00:00") + dt.timedelta(hours=(i * 37) % 96) for i in range(60)]
    data = [(i, t, 1, money("1.00")) for i, t in enumerate(times)]
    for part in range(10):
        write_batch(spark, intake.source, data[part::10] + data[:3])
    found = intake(maxFilesPerTrigger=1)
    assert [r[0] for r in found] == list(range(6, 66))
    assert sum(name.startswith("batch=") for name in os.listdir(f"{intake.out}/orders")) == 10
    # Ten micro-batches leave the intermediate table of one.
    assert set(os.listdir(intake.out)) == {"orders", "accepted", "numbered"}
    assert spark.read.parquet(f"{intake.out}/numbered").count() <= 9


def test_a_batch_that_runs_again_changes_nothing(intake):
    first = [(1, FIRST, 1, money("4.00")), (2, SECOND, 2, money("5.00"))]
    intake(first)
    once = intake([(3, SECOND, 1, money("6.00")), (1, FIRST, 1, money("4.00"))])
    os.remove(f"{intake.checkpoint}/commits/1")
    for name in os.listdir(f"{intake.checkpoint}/commits"):
        if name.startswith(".1."):
            os.remove(f"{intake.checkpoint}/commits/{name}")
    assert intake() == once


def test_repeats_are_combined_before_the_shuffle(spark):
    carts = spark.range(10_000).select(F.lit(1).alias("order_id"), F.lit(FIRST).alias("orderDate"), F.lit(money("1.00")).alias("total"))
    plan = live.distinct_carts(carts)._jdf.queryExecution().executedPlan().toString()
    assert live.distinct_carts(carts).count() == 1 and plan.count("partial_min") == 1


def order_stream(spark, shop, folder, files=4):
    """The shop's orders in files of their own, latest first."""
    for part in range(files):
        some = shop["ordertest"].orderBy(F.col("orderDate").desc()).where(F.col("orderID") % files == part)
        some.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(shop["ordertest"].schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_live_day_totals_equal_the_z_report(spark, shop, tmp_path, conf, zone):
    conf(spark__sql__session__timeZone=zone)
    out = str(tmp_path / "out")
    stream = order_stream(spark, shop, str(tmp_path / "in"))
    live.start_report(stream, live.day_partials, out, str(tmp_path / "check")).awaitTermination()
    days = {r["day"]: r for r in live.day_totals(spark, out).collect()}
    assert len(days) == 3
    for day, row in days.items():
        batch = reports.z_report(shop["ordertest"], day).first()
        names = ("totalSales", "totalOrders", "firstOrder", "lastOrder")
        assert [row[n] for n in names] == [batch[n] for n in names]


def test_live_hours_equal_the_x_report(spark, shop, tmp_path):
    out = str(tmp_path / "out")
    stream = order_stream(spark, shop, str(tmp_path / "in"))
    live.start_report(stream, live.hour_partials, out, str(tmp_path / "check")).awaitTermination()
    hours = live.hourly_sales(spark, out)
    day = sorted(rows(hours.where("date(hourStart) = '2025-06-23'").select("hourStart", "totalSales")))
    expected = rows(reports.x_report_hourly(shop["ordertest"], dt.date(2025, 6, 23)))
    assert [(f"{hour:%H:00}", total) for hour, total in day] == expected
    # Partials are written once: five orders, each in an hour of its own or together with one of its batch.
    assert spark.read.parquet(out).count() <= 5


def test_before_the_first_batch(spark, shop, tmp_path):
    os.makedirs(tmp_path / "in")
    stream = spark.readStream.schema(shop["ordertest"].schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    live.start_report(stream, live.day_partials, out, str(tmp_path / "check")).awaitTermination()
    assert live.day_totals(spark, out).count() == live.hourly_sales(spark, out).count() == 0
    assert live.accepted_orders(spark, out).count() == 0


# --- Generations ----------------------------------------------------------------------------


def test_spans_grow_with_the_logarithm():
    spans, written = (), 0
    for n in range(1000):
        before = (*spans, (n, n))
        spans = generations.merged_spans(before, 8)
        assert [x for a, b in spans for x in range(a, b + 1)] == list(range(n + 1))
        assert len(spans) <= 7 * 4
        written += spans[-1][1] - spans[-1][0] + 1 if spans[-1] != before[-1] else 0
    assert written <= 1000 * 4


def numbers_of(spark, parts):
    return sorted(r[0] for r in spark.read.parquet(*parts.folders(parts.latest())).select("n").collect())


def table_of_numbers(spark, path, **options):
    parts = generations.Generations(spark, path, **options)

    def write(batch):
        def own(folder):
            spark.createDataFrame([(batch,)], "n long").write.mode("overwrite").parquet(folder)
            return {"last": batch}

        return own

    def merge(folders, folder):
        spark.read.parquet(*folders).coalesce(1).write.mode("overwrite").parquet(folder)

    return parts, lambda batch: parts.add(batch, write(batch), merge)


def test_parts_stay_few_and_old_ones_go(spark, tmp_path):
    path = str(tmp_path / "t")
    parts, add = table_of_numbers(spark, path, fan_in=3, grace=2)
    assert parts.latest().spans == ()
    for batch in range(20):
        assert add(batch).note == {"last": batch}
        assert numbers_of(spark, parts) == list(range(batch + 1))
        assert len([n for n in os.listdir(path) if n.startswith("span=")]) <= 2 * 3 + 3 + 3
        assert len([n for n in os.listdir(f"{path}/_parts") if n.isdigit()]) <= 3
    assert parts.latest().spans == ((0, 8), (9, 17), (18, 18), (19, 19))


def test_a_break_before_the_marker_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    parts, add = table_of_numbers(spark, path, fan_in=2)
    for batch in range(4):
        # Each batch breaks off once with all its folders written, then runs again.
        with monkeypatch.context() as broken:
            broken.setattr(generations.Generations, "_mark", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                add(batch)
        if batch:
            assert numbers_of(spark, parts) == list(range(batch))
        add(batch)
        assert numbers_of(spark, parts) == list(range(batch + 1))
    # A batch that is done is not written again.
    parts.add(3, lambda folder: pytest.fail("written twice"), lambda *a: None)
    with pytest.raises(ValueError, match="can't follow"):
        add(7)


def test_a_reader_keeps_its_parts_while_others_merge(spark, tmp_path):
    parts, add = table_of_numbers(spark, str(tmp_path / "t"), fan_in=2, grace=3)
    for batch in range(3):
        add(batch)
    held = spark.read.parquet(*parts.folders(parts.latest()))
    for batch in range(3, 6):
        add(batch)
    assert sorted(r.n for r in held.collect()) == [0, 1, 2]


def test_two_streams_cannot_share_a_path(spark, tmp_path):
    path = str(tmp_path / "t")
    table_of_numbers(spark, path, owner="a")[1](0)
    with pytest.raises(ValueError, match="another stream"):
        table_of_numbers(spark, path, owner="b")[1](1)


def test_many_batches_leave_few_files(spark, intake, monkeypatch):
    monkeypatch.setattr(generations.Generations.__init__, "__defaults__", ("", 3, 2))
    start = at("2025-07-01T00:00:00")
    data = [(i, start + dt.timedelta(hours=(i * 7) % 48), 1, money("1.00")) for i in range(40)]
    for part in range(10):
        write_batch(spark, intake.source, data[part::10] + data[:2])
    found = intake(maxFilesPerTrigger=1)
    assert [r[0] for r in found] == list(range(6, 46))
    spans = [name for name in os.listdir(f"{intake.out}/accepted") if name.startswith("span=")]
    assert len(spans) <= 2 * 3 + 3 + 2 and sum(len(f) for _, _, f in os.walk(f"{intake.out}/accepted")) <= 150


def test_reports_are_merged(spark, shop, tmp_path, monkeypatch):
    monkeypatch.setattr(generations.Generations.__init__, "__defaults__", ("", 2, 0))
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    stream = order_stream(spark, shop, source)
    live.start_report(stream, live.hour_partials, out, str(tmp_path / "check")).awaitTermination()
    assert [name for name in os.listdir(out) if name.startswith("span=")] == ["span=0-3"]
    want = sorted(rows(live.hour_partials(shop["ordertest"]).select("hourStart", "totalSales", "totalOrders")))
    assert sorted(rows(live.hourly_sales(spark, out))) == want
