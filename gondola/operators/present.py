"""What the dashboard derives and how it writes values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.exprs import fixed_units, half_up, present, share_pct, to_fixed


def _missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c.cast("double"))


def grouped_number(c: Column) -> Column:
    """Whole numbers with points between thousands; 0 for null and NaN."""
    return F.when(_missing(c), "0").otherwise(F.translate(F.format_number(F.round(c.cast("decimal(38,6)"), 0), 0), ",", "."))


def format_price(c: Column, sign: str = "$") -> Column:
    whole = F.round(c.cast("decimal(38,6)"), 0)
    minus = F.when(whole < 0, "-").otherwise("")
    return F.when(_missing(c), "N/D").otherwise(F.concat(minus, F.lit(sign + "\u00a0"), grouped_number(F.abs(c))))


def format_pct(c: Column) -> Column:
    """A fraction as a percentage with one digit; a plus where it is above zero."""
    pct = c.cast("double") * 100
    return F.when(_missing(c), "N/D").otherwise(F.concat(F.when(pct > 0, "+").otherwise(""), to_fixed(pct, 1), F.lit("%")))


# Each position's colour, badge and wording; the last row is for all others.
POSITION_LOOKS = (
    ("BEAT", "#E31837", "bml-beat", "BEAT — Comp. más barata"),
    ("MEET", "#F5A623", "bml-meet", "MEET — Precio similar"),
    ("LOSE", "#27AE60", "bml-lose", "LOSE — Nike más barata"),
    (None, "#9B9B9B", "bml-nd", "N/D"),
)


def _look(c: Column, field: int) -> Column:
    out = F.lit(POSITION_LOOKS[-1][field])
    for row in POSITION_LOOKS[:-1]:
        out = F.when(F.upper(c) == row[0], row[field]).otherwise(out)
    return out


def position_colour(c: Column) -> Column:
    return _look(c, 1)


def position_badge(c: Column) -> Column:
    return _look(c, 2)


def position_name(c: Column) -> Column:
    return _look(c, 3)


def normal_division(c: Column) -> Column:
    up = F.upper(c)
    return (
        F.when(~present(c) | c.isNull(), "N/D")
        .when(up.contains("FOOT") | (up == "FW"), "Footwear")
        .when(up.contains("APP") | (up == "AP"), "Apparel")
        .when(up.contains("EQUIP") | (up == "EQ"), "Equipment")
        .otherwise(c)
    )


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def position_shares(kpis: DataFrame) -> DataFrame:
    """Beaten and lost shares in whole percents; rows without position don't count."""
    total = F.col("total_beat") + F.col("total_meet") + F.col("total_lose")
    share = lambda c: F.when(total > 0, share_pct(F.col(c), total)).otherwise(0).cast("long")
    return kpis.select(share("total_beat").alias("beat_pct"), share("total_lose").alias("lose_pct"))


def position_slices(positions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The slices of each row of positions, empty ones left out, with their share of
    the row (nd included): one digit in the tooltip, none in the legend."""
    total = F.col("beat") + F.col("meet") + F.col("lose") + F.col("nd")
    slices = positions.withColumn("_total", total).unpivot([*keys, "_total"], ["beat", "meet", "lose", "nd"], "name", "value").where("value > 0")
    share = F.col("value").cast("double") / F.col("_total") * 100
    return slices.select(*keys, "name", "value", (fixed_units(share, 1) / 10).alias("pct_tooltip"), fixed_units(share, 0).cast("double").alias("pct_legend"))


def franchises_by_brand(listed: DataFrame) -> DataFrame:
    """How many of the listed franchises each brand has."""
    return listed.groupBy("marca").agg(F.count("*").alias("franchises"))


def franchise_bars(listed: DataFrame, n: int = 15) -> DataFrame:
    """Each brand's largest franchises with the share that is beaten; ``place`` counts
    from the smallest, as the bars are drawn."""
    order = Window.partitionBy("marca").orderBy(F.desc("count"), "franchise", F.asc_nulls_first("division"))
    total = F.col("beat") + F.col("meet") + F.col("lose")
    ranked = listed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    beaten = F.when(total > 0, share_pct(F.col("beat"), total)).otherwise(0).cast("long")
    last = F.max("_r").over(Window.partitionBy("marca"))
    return ranked.select("marca", "franchise", "division", "count", beaten.alias("beat_pct"), (last - F.col("_r") + 1).cast("long").alias("place"))


def retailers_monitored(winners: DataFrame) -> DataFrame:
    return winners.agg(F.countDistinct("canal").alias("retailers"))


def shelf_bars(shares: DataFrame) -> DataFrame:
    """Brands within a channel by share, labelled from 12 percent."""
    order = Window.partitionBy("canal").orderBy(F.desc("pct"), "marca")
    return shares.select("canal", "marca", "pct", F.row_number().over(order).cast("long").alias("place"), F.when(F.col("pct") >= 12, F.concat(F.col("pct").cast("string"), F.lit("%"))).alias("label"))


def search_detail(table: DataFrame, n: int = 80) -> DataFrame:
    """The first searches, with the number of all."""
    every = Window.partitionBy()  # of one row for each channel
    totals = table.groupBy("canal").agg(F.count("*").alias("_n")).withColumn("total", F.sum("_n").over(every)).select("canal", "total")
    return table.orderBy("canal", "search_term").limit(n).join(totals, "canal")


def visibility_pct(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.concat(half_up(c * 100).cast("long").cast("string"), F.lit("%")))


def product_lines(page: DataFrame) -> DataFrame:
    """The product listing's cells."""
    gap = F.col("gap_final_price_pct")
    return page.select(
        "id",
        F.coalesce(F.nullif("style_color", F.lit("")), F.col("productcode_competitor")).alias("code"),
        F.coalesce(F.nullif("product_name_competitor", F.lit("")), F.col("marketing_name")).alias("name"),
        F.when(gap.isNull(), "—").otherwise(format_pct(gap)).alias("gap"),
        F.when(F.col("competitor_markdown") > 0, F.col("competitor_full_price")).alias("struck_price"),
        F.col("competitor_final_price").alias("price"),
    )


def page_window(page: int, total_pages: int, buttons: int = 5) -> list[int]:
    """The page buttons shown around the current page."""
    first = max(1, min(page - 2, total_pages - buttons + 1))
    return list(range(first, min(first + buttons - 1, total_pages) + 1))


def page_windows(listings: DataFrame, buttons: int = 5) -> DataFrame:
    """:func:`page_window` for each page of each listing (its other columns, and pages)."""
    first = F.greatest(F.lit(1), F.least(F.col("page") - 2, F.col("pages") - buttons + 1))
    shown = listings.where("pages > 0").withColumn("page", F.explode(F.expr("sequence(1L, pages)")))
    return shown.withColumn("button", F.explode(F.sequence(first, F.least(first + buttons - 1, F.col("pages"))))).drop("pages")
