"""Loads that stop anywhere, at once, and again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gondola.schema import ALERTS, PRICING, RUNS
from gondola.sources import ingest, versions
from gondola.sources.versions import RunClosed, VersionedTable

HEADER = "Scraper,Marca,Competitor_Full_Price\n"


@pytest.fixture
def feed(tmp_path):
    def make(name, n, bad=0):
        (tmp_path / name).write_text(HEADER + "".join(f"{name},NIKE,{i}\n" for i in range(n)) + f"{name},big,1e12\n" * bad)
        return f"{tmp_path}/{name}"

    return make


def ids(spark, table, version=None):
    return sorted(r.id for r in ingest.read_prices(spark, table, version).select("id").collect())


def test_ids_are_dense_over_loads_and_restart(spark, tmp_path, feed):
    table = f"{tmp_path}/t"
    assert ids(spark, table) == [] and ingest.run_log(spark, table).count() == 0 and ingest.quarantined(spark, table) is None
    assert ingest.load(spark, feed("a", 5, 2), table).status == "partial"
    assert ingest.load(spark, feed("none", 0), table).inserted == 0
    assert ingest.load(spark, feed("b", 3), table).status == "success"
    assert ids(spark, table) == list(range(1, 9))
    rows = ingest.read_prices(spark, table)
    assert rows.schema.fieldNames() == PRICING.fieldNames() and rows.where("created_at is null").count() == 0
    assert {r.scraper: r.n for r in rows.groupBy("scraper").agg(F.min("id").alias("n")).collect()} == {"a": 1, "b": 6}
    before = VersionedTable(spark, table).numbers()[-1]
    ingest.load(spark, feed("c", 4, 1), table, truncate=True)
    assert ids(spark, table) == [1, 2, 3, 4] and ids(spark, table, before) == list(range(1, 9))
    assert ingest.quarantined(spark, table).count() == 3
    assert [r.status for r in ingest.run_log(spark, table).collect()] == ["partial", "success", "success", "partial"]
    VersionedTable(spark, table).vacuum()
    assert ids(spark, table) == [1, 2, 3, 4]


STEPS = [(ingest, "read_csv"), (ingest, "stage"), (ingest, "numbered"), (ingest, "with_defaults"), (VersionedTable, "finish"), (VersionedTable, "delete")]


@pytest.mark.parametrize("where,step,late", [(*s, False) for s in STEPS] + [(ingest, "stage", True), (VersionedTable, "finish", True)])
def test_a_load_that_stops_is_taken_up(spark, tmp_path, feed, monkeypatch, where, step, late):
    """Stopped before or after each step, then loaded again under the same id."""
    table, path = f"{tmp_path}/t", feed("a", 3, 1)
    ingest.load(spark, feed("first", 2), table)
    real = getattr(where, step)

    def stop(*args, **more):
        if late:
            real(*args, **more)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(where, step, stop)
        with pytest.raises(KeyboardInterrupt):
            ingest.load(spark, path, table, run_id="r")
    published = step == "delete" or step == "finish" and late
    assert ids(spark, table) == list(range(1, 6 if published else 3))
    for _ in range(2):  # the second time it is done
        report = ingest.load(spark, path, table, run_id="r")
        assert (report.status, report.inserted, report.errors) == ("partial", 3, 1)
        assert ids(spark, table) == [1, 2, 3, 4, 5] and ingest.quarantined(spark, table).count() == 1
    assert {r.id: r.status for r in ingest.run_log(spark, table).collect()}["r"] == "partial"


def test_dead_runs_are_closed(spark, tmp_path, feed):
    table = f"{tmp_path}/t"
    target = VersionedTable(spark, table)
    target.begin("dead", "csv_load", dt.timedelta(hours=1))
    ingest.load(spark, feed("a", 1), table)
    assert {r.id: r.status for r in ingest.run_log(spark, table).collect()}["dead"] == "running"
    ingest.load(spark, feed("a", 1), table, dead_after=dt.timedelta(0))
    runs = {r.id: r for r in ingest.run_log(spark, table).collect()}
    assert runs["dead"].status == "failed" and runs["dead"].finished_at is not None
    with pytest.raises(RunClosed):
        target.finish("dead", 7, 0)
    assert ids(spark, table) == [1, 2]


def test_loads_at_once_follow_each_other(spark, tmp_path, monkeypatch):
    """A version whose number another took is made anew on top of it."""
    one, two = (VersionedTable(spark, f"{tmp_path}/t") for _ in range(2))
    for t, run in ((one, "a"), (two, "b")):
        t.begin(run, "x", dt.timedelta(hours=1))
    stale, real = one.runs(), one.runs
    two.finish("b", 10, 0)
    answers = [stale]
    monkeypatch.setattr(one, "runs", lambda number=None: answers.pop() if answers else real(number))
    assert one.finish("a", 5, 0).first_id == 11
    assert [(r.id, r.first_id) for r in real()[1]] == [("b", 1), ("a", 11)]


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    path = f"{tmp_path}/rows"
    spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(6).write.parquet(path)
    found = set()
    for size in ("128m", "2k"):
        kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows, n = versions.numbered(spark.read.parquet(path))
        got = {(r.id, r.x) for r in rows.collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        assert n == 1000 and sorted(i for i, _ in got) == list(range(1, 1001))
        found.add(frozenset(got))
    assert len(found) == 1


def test_defaults_of_the_other_tables(spark):
    runs = ingest.with_defaults(spark.createDataFrame([("a",), ("b",)], "scraper_name string"), "runs")
    assert runs.schema.fieldNames() == RUNS.fieldNames()
    rows = runs.collect()
    assert len({r.id for r in rows}) == 2 and all((r.status, r.rows_inserted, r.rows_updated, r.errors, r.finished_at) == ("running", 0, 0, [], None) and r.started_at for r in rows)
    alert = spark.createDataFrame([("s", "blocked", "m", "critical"), ("s", "no_data", "m", "info")], "scraper_name string, alert_type string, message string, severity string")
    alerts = ingest.with_defaults(alert, "alerts")
    assert alerts.schema.fieldNames() == ALERTS.fieldNames()
    assert [(r.severity, r.context, r.sent_email, r.sent_at) for r in alerts.collect()] == [("critical", {}, False, None), ("info", {}, False, None)]
    assert ingest.with_defaults(alert.drop("severity"), "alerts").first().severity == "warning"
    with pytest.raises(ValueError):
        ingest.with_defaults(alert.drop("message"), "alerts")
    with pytest.raises(Exception, match="message is null"):
        ingest.with_defaults(alert.withColumn("message", F.lit(None).cast("string")), "alerts").collect()


def test_a_load_stores_the_columns_of_its_file(spark, tmp_path, feed):
    table = f"{tmp_path}/t"
    ingest.load(spark, feed("a", 3, 1), table, run_id="r")
    assert spark.read.parquet(VersionedTable(spark, table).data("r")).columns == ["id", "scraper", "marca", "competitor_full_price", "created_at"]
    (tmp_path / "other").write_text("Unknown\n1\n2\n")
    assert ingest.load(spark, f"{tmp_path}/other", table).inserted == 2
    rows = ingest.read_prices(spark, table)
    assert rows.schema.fieldNames() == PRICING.fieldNames() and rows.where("scraper is null and marca is null").count() == 2
    assert ids(spark, table) == [1, 2, 3, 4, 5]


def test_staging_writes_rows_of_both_kinds_unsorted(spark, tmp_path):
    """Sorted by kind, all good rows of a task would be held back; and both kinds' columns are flat."""
    raw = spark.range(1000).selectExpr("if(id % 7 = 0, '1e12', '5') as Competitor_Full_Price", "cast(id as string) as Marca").coalesce(1)
    before = {k: spark.conf.get(k) for k in ingest._STAGING}
    ingest.stage(raw, f"{tmp_path}/s")
    assert before == {k: spark.conf.get(k) for k in before}
    assert int(ingest._STAGING["spark.sql.maxConcurrentOutputFileWriters"]) > 2 and "good_0" in spark.read.parquet(f"{tmp_path}/s").columns
    good, bad = (ingest._staged(spark, f"{tmp_path}/s", kind, raw) for kind in (False, True))
    assert [int(r.marca) for r in good.collect()] == [i for i in range(1000) if i % 7]
    assert {(r.Competitor_Full_Price, int(r.Marca)) for r in bad.collect()} == {("1e12", i) for i in range(0, 1000, 7)}


def test_four_loads_of_one_file(spark, sf_dir, monkeypatch):
    from gondola.plans import catalogue

    real, made = catalogue._odd_csv, []
    monkeypatch.setattr(catalogue, "_odd_csv", lambda p: made.append(real(p)) or made[-1])
    found = {r.what: r for r in catalogue.QUERIES["A12_serial_ids"](spark, sf_dir).collect()}
    assert len(made) == 1 and found["two loads"].last == 2 * found["truncated"].last == found["two loads"].ids
