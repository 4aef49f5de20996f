"""Edge rows that the test tables lack."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gondola.functions.exprs import like_pattern
from gondola.operators import present as show
from gondola.operators import pricing as price
from gondola.operators import shelf as shelves
from gondola.operators import views
from gondola.operators.filters import ProductParams
from gondola.schema import PRICING, SHELF
from gondola.sources.ingest import clean, load, read_csv, read_prices, run_log


@pytest.fixture(scope="module")
def prices(spark):
    def make(*rows):
        names = PRICING.fieldNames()
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], PRICING)

    return make


def money(x):
    return None if x is None else Decimal(x)


def test_two_meanings_of_no_position(prices):
    rows = prices(*[{"scraper": "s", "marca": "NIKE", "bml_final_price": x} for x in ("BEAT", "MEET", "LOSE", "N/D", "NO_US_DATA", None)])
    assert views.bml_summary(rows).first().nd == 2
    assert price.brand_positions(rows, "NIKE").first().nd == 3


def test_feeds_without_a_name_and_direct_feeds(prices):
    cheap = {"marca": "NIKE", "competitor_final_price": money("10"), "precio_sugerido": money("100")}
    rows = prices({"scraper": None} | cheap, {"scraper": "ADIDAS_7"} | cheap, {"scraper": "URU"} | cheap, {"scraper": "shop"} | cheap)
    assert [r.scraper for r in price.pvp_violations(rows).collect()] == ["ADIDAS_7", "shop"]
    assert [r.scraper for r in price.pvp_by_retailer(rows).collect()] == ["shop"]
    assert [r.scraper for r in price.markdown_by_retailer(rows).collect()] == ["shop"]


def test_suggested_price_bands(prices):
    row = lambda pvp, p: {"scraper": "s", "marca": "NIKE", "competitor_final_price": money(p), "precio_sugerido": money(pvp)}
    r = price.pvp_by_retailer(prices(*[row("100", p) for p in ("95.00", "94.99", "105.00", "105.01")])).first()
    assert (r.with_pvp, r.compliant, r.below_pvp, r.above_pvp, r.compliance_pct) == (4, 2, 1, 1, 50)
    r = price.pvp_by_retailer(prices(row("0", "50"))).first()
    assert (r.with_pvp, r.compliant, r.below_pvp, r.above_pvp) == (1, 0, 0, 1)
    assert price.pvp_by_retailer(prices(row(None, "50"))).first().compliance_pct is None


def test_markdown_is_a_mean_of_ratios(prices):
    row = lambda cut, full: {"scraper": "s", "marca": "X", "competitor_markdown": money(cut), "competitor_full_price": money(full)}
    r = price.markdown_by_brand(prices(row("10", "100"), row("900", "1000"), row("10", "0"), row(None, "10"), row("0", "10"))).first()
    assert (r.total, r.in_promo, r.avg_markdown_pct) == (5, 3, 50.0)
    assert price.top_markdowns(prices(row("10", "0"))).count() == 0


def test_products_without_price_come_last(prices):
    rows = prices({"id": 1}, {"id": 2, "competitor_final_price": money("5")}, {"id": 3, "competitor_final_price": money("7")})
    assert [r.id for r in price.product_page(rows, ProductParams(page=0, page_size=500)).collect()] == [3, 2, 1]
    assert price.page_envelope(0, 0, 500) == {"total": 0, "page": 1, "pageSize": 100, "totalPages": 0}


def test_user_patterns(prices):
    assert like_pattern("a%b") == "%a%b%" and like_pattern("a\\z") == "%az%" and like_pattern("a\\%") == "%a\\%%"
    rows = prices({"id": 1, "style_color": "AxxB"}, {"id": 2, "style_color": "ab"}, {"id": 3})
    assert [r.id for r in price.product_page(rows, ProductParams(search="a_\\xb")).collect()] == [1]


def test_shelf_winners(spark):
    def shelf(*rows):
        names = SHELF.fieldNames()
        return spark.createDataFrame([tuple({"id": i, "canal": "c", "search_term": "t", "marca": m, "nike_visibility": v}.get(n) for n in names) for i, (m, v) in enumerate(rows)], SHELF)

    two = shelf(("Nike", 0.9), ("Nike", 0.1), ("Adidas", 0.5))
    assert shelves.winners(two).first().marca == "Nike"
    assert shelves.search_table(two).first()[2:] == (0.1, 0.5, None, "Adidas")
    assert shelves.search_table(shelf(("Nike", 0.5), ("Adidas", 0.5))).first().winner == "Nike"
    other = shelf(("Topper", 0.3))
    assert shelves.search_table(other).first().winner == "Nike" and shelves.winners(other).first().marca == "Topper"
    unseen = shelf(("Nike", None))
    assert shelves.term_totals(unseen).first().total == 1 and shelves.winners(unseen).count() == shelves.search_table(unseen).count() == 0


def test_rounding_and_texts(spark):
    df = spark.range(1).select(show.format_price(F.lit(-1234567.5)).alias("a"), show.format_pct(F.lit(0.0)).alias("b"), show.format_pct(F.lit(0.1234)).alias("c"), show.grouped_number(F.lit(None).cast("double")).alias("d"), show.visibility_pct(F.lit(0.125)).alias("e"), show.format_price(F.lit(float("nan"))).alias("f"))
    assert tuple(df.first()) == ("-$ 1.234.568", "0.0%", "+12.3%", "0", "13%", "N/D")
    assert show.page_window(1, 3) == [1, 2, 3] and show.page_window(9, 10) == [6, 7, 8, 9, 10]


CSV = '﻿Fecha_Corrida,Scraper,Competitor_Full_Price,Size_Available_Competitor,Price_Index,Marketing_Name,Odd\r\n2026-8-1, s ,12.345,2.5,1_000.5,"say ""hi"", now\nand then",x\r\n10/08/2026,NAN,12d,inf,1e2,N/D,x\r\n2026-08-10,nan,N/D,,,"None",x\r\n2026-08-10,big,1e11,1,1,y,x\r\n2026-08-11,short\r\n'


def test_ingest(spark, tmp_path):
    (tmp_path / "in.csv").write_text(CSV, encoding="utf-8", newline="")
    good, bad = clean(read_csv(spark, f"{tmp_path}/in.csv"))
    rows = {r.scraper: r for r in good.collect()}
    s = rows["s"]
    assert (str(s.fecha_corrida), s.competitor_full_price, s.size_available_competitor, s.price_index, s.marketing_name) == ("2026-08-01", Decimal("12.35"), 3, Decimal("1000.5"), 'say "hi", now\nand then')
    n = rows["NAN"]
    assert (n.fecha_corrida, n.competitor_full_price, n.size_available_competitor, n.price_index, n.marketing_name) == (None, None, None, Decimal("100"), "N/D")
    assert rows[None].marketing_name is None and rows["short"].marketing_name is None
    assert [r.Scraper for r in bad.collect()] == ["big"]
    for truncate, total in ((False, 4), (False, 8), (True, 4)):
        report = load(spark, f"{tmp_path}/in.csv", f"{tmp_path}/table", truncate)
        assert (report.status, report.total, report.inserted, report.errors) == ("partial", 5, 4, 1)
        assert read_prices(spark, f"{tmp_path}/table").count() == total
    runs = run_log(spark, f"{tmp_path}/table").collect()
    assert [r.status for r in runs] == ["partial"] * 3 and all(r.rows_inserted == 4 for r in runs)


def test_live_summary(spark, tmp_path):
    from gondola.streaming.live import live_summary, price_stream

    (tmp_path / "in").mkdir()
    header = ",".join(["Fecha_Corrida", "Scraper", "Canal", "Marca"])
    (tmp_path / "in" / "a.csv").write_text(header + "\n2026-08-01,s,c,NIKE\n2026-08-01,s,c,NIKE\n")
    q = live_summary(price_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.scraper, r.marca, r.total) for r in spark.table("live").collect()] == [("s", "NIKE", 2)]


def test_plans_are_native_and_pushed_down(spark, sf_dir):
    from gondola.plans import catalogue

    plan = catalogue.QUERIES["Q17_winners"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan
    plan = catalogue.QUERIES["V01_bml_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "Python" not in plan


def test_shares_divide_first(prices):
    row = lambda p: {"scraper": "s", "marca": "NIKE", "competitor_final_price": money(p), "precio_sugerido": money("100")}
    for compliant, total, expected in ((23, 40, 57), (29, 200, 14), (46, 80, 57), (1, 2, 50), (1, 8, 13)):
        r = price.pvp_by_retailer(prices(*[row("100")] * compliant, *[row("10")] * (total - compliant))).first()
        assert (r.with_pvp, r.compliant, r.compliance_pct) == (total, compliant, expected)
    kpis = prices(*[{"marca": "NIKE", "bml_final_price": "BEAT"}] * 23, *[{"marca": "NIKE", "bml_final_price": "LOSE"}] * 17)
    assert show.position_shares(price.summary_kpis(kpis)).first().beat_pct == 57


def test_page_windows_agree_with_page_window(spark):
    listings = spark.createDataFrame([(n,) for n in range(0, 12)], "pages long").withColumn("name", F.col("pages"))
    found = {}
    for r in show.page_windows(listings).collect():
        found.setdefault((r.name, r.page), []).append(r.button)
    assert {k: sorted(v) for k, v in found.items()} == {(n, p): show.page_window(p, n) for n in range(1, 12) for p in range(1, n + 1)}


def test_digits_of_doubles_are_exact(spark):
    """Against the exact rational value of each double, ties up; and the known cases."""
    from fractions import Fraction

    from gondola.functions.exprs import to_fixed

    values = [a / b * 100 for b in (80, 160, 400, 7, 640) for a in range(b + 1)] + [0.05, 0.15, 0.25, 0.95, 1.005, 1e9 + 0.25, 0.049999999999999996, 5e-324, 0.0, -0.25, -0.0294, -3.95]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").select("i", *[to_fixed(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2)]).collect()
    for r in rows:
        exact = Fraction(values[r.i])
        for d in (0, 1, 2):
            units = int(abs(exact) * 10**d + Fraction(1, 2))
            text = f"{units // 10**d}" + (f".{units % 10**d:0{d}d}" if d else "")
            assert r[f"d{d}"] == ("-" if exact < 0 else "") + text, values[r.i]
    shown = spark.createDataFrame([(1.8855,), (-0.000294,), (0.0,), (0.1234,)], "v double").select(show.format_pct(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["+188.5%", "-0.0%", "0.0%", "+12.3%"]
    slices = show.position_slices(spark.createDataFrame([(23, 57, 0, 0)], "beat long, meet long, lose long, nd long")).collect()
    assert [(r.name, r.pct_tooltip, r.pct_legend) for r in slices] == [("beat", 28.7, 29.0), ("meet", 71.3, 71.0)]
