"""Copies in the questions' order, against the loads' own files."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gondola.schema import PRICING
from gondola.sources import clustered, ingest
from gondola.sources.clustered import PRICES, Clustered, Layout, rows_scanned
from gondola.sources.versions import VersionedTable


def feed(spark, start, n):
    """``n`` rows, two thirds of one brand; codes in no order, nulls in every column of the layout."""
    at = F.col("id")
    return spark.range(start, start + n, 1, 3).select(
        F.when(at % 31 == 0, None).when(at % 3 > 0, "NIKE").when(at % 2 == 0, "ADIDAS").otherwise("Puma").alias("marca"),
        F.when(at % 37 == 0, None).otherwise(F.concat(F.lit("feed"), (at % 7).cast("string"))).alias("scraper"),
        F.when(at % 41 == 0, None).otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (at % 20).cast("int"))).alias("fecha_corrida"),
        F.when(at % 43 == 0, None).otherwise(F.concat(F.lit("SC"), (at * 7919 % 100003).cast("string"))).alias("style_color"),
        F.when(at % 2 == 0, "").otherwise("F").alias("franchise_competitor"),
    )


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"{tmp_path}/prices")


SMALL = Layout("small", PRICING, PRICES.order, PRICES.codes, file_rows=1500, group_rows=200)


def ordered(df):
    return list(map(str, df.orderBy("id").collect()))


def same(table, copies, number=None):
    assert ordered(copies.rows(number)) == ordered(table.read(PRICING, number))


def test_copies_follow_every_load(spark, table):
    copies = Clustered(table, SMALL)
    assert copies.rows().count() == 0 and copies.refresh() == 0
    for n, truncate in ((40, False), (300, False), (0, False), (70, True), (20, False)):
        ingest.append(feed(spark, n, n), table.path, truncate=truncate)
        same(table, copies)  # a load without a copy is read from its own files
        assert copies.refresh() == (n > 0) and copies.refresh() == 0
        same(table, copies)
    same(table, copies, 4)  # an older version, two loads
    copies.vacuum()
    assert len(table.children(copies.path)) == 2
    same(table, copies)


def test_a_copy_that_stopped_is_made_again(spark, table, monkeypatch):
    ingest.append(feed(spark, 0, 50), table.path)
    copies = Clustered(table, SMALL)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "rename", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            copies.refresh()
    same(table, copies)
    assert copies.refresh() == 1
    same(table, copies)
    monkeypatch.setattr(clustered, "DEAD_DRAFT_S", -1)
    copies.vacuum()
    assert list(table.children(copies.path)) == [f"run={table.runs()[1][0].id}"]


def test_filters_skip_row_groups(spark, table):
    n = 12_000
    ingest.append(feed(spark, 0, n), table.path)
    copies = Clustered(table, SMALL)
    copies.refresh()
    bare = Clustered(table, replace(SMALL, name="bare", codes=()))
    bare.refresh()
    assert rows_scanned(bare.rows().where("style_color = 'SC7919'")) > 0.5 * n  # no Bloom filters
    hot = copies.rows().where("marca = 'NIKE'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) > 3  # the brand that most rows hold is split over files
    for where, share in (("marca = 'Puma'", 0.3), ("marca = 'NIKE' and scraper = 'feed3'", 0.2), ("marca = 'NIKE' and scraper = 'feed3' and fecha_corrida = date'2024-01-05'", 0.1), ("style_color = 'SC7919'", 0.2), ("style_color = 'none'", 0.1)):
        mine, full = copies.rows().where(where), table.read(PRICING).where(where)
        assert ordered(mine) == ordered(full)
        assert rows_scanned(table.read(PRICING).where(where)) > 0.5 * n or "none" in where
        assert rows_scanned(copies.rows().where(where)) <= share * n, where
