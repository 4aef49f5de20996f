"""Pages by histograms against a full sort."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gondola.operators import paging
from gondola.operators import pricing as price
from gondola.operators.filters import ProductParams
from gondola.schema import PRICING


@pytest.fixture(scope="module")
def listing(spark):
    """Many rows of one price, no price, negative and far prices, repeated ids."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        kind = rng.random()
        cents = None if kind < 0.2 else 1999 if kind < 0.6 else rng.choice([-5, 0, 9_999_999_999]) if kind < 0.65 else rng.randint(1, 400_000)
        rows.append({"id": rng.choice([i, i, 7, None]), "competitor_final_price": None if cents is None else Decimal(cents) / 100, "marca": rng.choice(["NIKE", "ADIDAS"]), "style_color": f"s{rng.randint(0, 99)}"})
    names = PRICING.fieldNames()
    df = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], PRICING).repartition(3)
    df.cache().count()
    return df


@pytest.mark.parametrize("held,bins", [(40, 4096), (25, 6)])
@pytest.mark.parametrize("params", [ProductParams(page_size=37), ProductParams(page_size=100, marca="NIKE"), ProductParams(marca="none")])
def test_pages_are_those_of_a_sort(listing, monkeypatch, held, bins, params):
    monkeypatch.setattr(paging, "BINS", bins)
    rows, order = price._listing(listing, params)
    every = [tuple(r) for r in rows.orderBy(*order).collect()]
    size = min(100, params.page_size)
    pages = -(-len(every) // size)
    for n in {1, 2, pages // 2, pages - 1, pages, pages + 1}:
        if n > 0:
            found = price.deep_page(listing, ProductParams(**{**params.__dict__, "page": n}), held)
            assert [tuple(r) for r in found.collect()] == every[(n - 1) * size : n * size], n


def test_far_pages_sort_few_rows(spark):
    names = PRICING.fieldNames()
    wide = spark.range(30_000).select(*[F.col("id") if c == "id" else (F.hash("id") % 1_000_000 / 100).cast("decimal(12,2)").alias(c) if c == "competitor_final_price" else F.lit(None).cast(PRICING[c].dataType).alias(c) for c in names])
    rows, _ = price._listing(wide, ProductParams())
    keys = [paging.Key("competitor_final_price", -(F.col("competitor_final_price") * 100).cast("long"), True), paging.Key("id", F.col("id"), False)]
    pieces = paging.find(rows, keys, 29_000, 50, 200)
    assert sum(rows.where(p.where).count() for p in pieces) <= 400 and sum(p.take for p in pieces) == 50
    assert "TakeOrderedAndProject" in price.product_page(wide, ProductParams(page=300))._jdf.queryExecution().executedPlan().toString()
    assert price.product_page(wide, ProductParams(page=300)).count() == 50


def test_the_shelf_body_scans_once(spark, sf_dir):
    from gondola.operators import responses
    from gondola.sources.testdata import shelf

    plan = responses.shelf_summary(shelf(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan
