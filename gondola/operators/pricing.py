"""Endpoint queries over the price table. Orders are total: ties that the
question leaves open fall by the output columns."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.exprs import avg_ratio, avg_rounded, count_if, pct, position_counts, present, ratio, rounded, share_pct
from gondola.operators import paging
from gondola.operators.filters import FranchiseParams, ProductParams, SilhouetteParams
from gondola.schema import NAMES, Names

TOP_BRAND, TOP_LIST = 10, 100
LOW, HIGH, BAND = Decimal("0.95"), Decimal("1.05"), Decimal("0.05")


def _price() -> Column:
    return F.col("competitor_final_price")


def summary_kpis(pricing: DataFrame, names: Names = NAMES) -> DataFrame:
    """One row: counts by brand, average prices, positions over all three brands."""
    brand = F.col("marca")
    return pricing.where(brand.isin(*names.brands)).agg(
        count_if(brand == names.rival).alias("adidas_total"),
        count_if(brand == names.second).alias("puma_total"),
        count_if(brand == names.own).alias("nike_total"),
        avg_rounded(_price(), 0, brand == names.rival).alias("adidas_avg_price"),
        avg_rounded(_price(), 0, brand == names.second).alias("puma_avg_price"),
        *position_counts(F.col("bml_final_price"), null_as_nd=True, prefix="total_"),
    )


def brand_positions(pricing: DataFrame, brand: str) -> DataFrame:
    """One row: the positions of one brand."""
    return pricing.where(F.col("marca") == brand).agg(*position_counts(F.col("bml_final_price"), null_as_nd=True))


def top_franchises(pricing: DataFrame, brand: str, limit: int = TOP_BRAND) -> DataFrame:
    grouped = pricing.where((F.col("marca") == brand) & present("franchise_competitor")).groupBy(F.col("franchise_competitor").alias("franchise"))
    found = grouped.agg(F.count("*").alias("count"), avg_rounded(_price(), 0).alias("avg_price"), avg_rounded(F.col("gap_final_price_pct"), 4).alias("avg_gap_pct"))
    return found.orderBy(F.desc("count"), "franchise").limit(limit)


def franchises(pricing: DataFrame, params: FranchiseParams = FranchiseParams(), limit: int = TOP_LIST) -> DataFrame:
    promo = F.col("competitor_markdown") > 0
    keys = [F.col("franchise_competitor").alias("franchise"), "marca", F.col("division_competitor").alias("division")]
    found = (
        pricing.where(params.predicate())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("count"),
            avg_rounded(_price(), 0).alias("avg_price"),
            avg_rounded(F.col("competitor_full_price"), 0).alias("avg_full_price"),
            avg_rounded(F.col("gap_final_price_pct"), 4).alias("avg_gap_pct"),
            *position_counts(F.col("bml_final_price"), null_as_nd=True),
            avg_rounded(F.col("size_available_competitor"), 1).alias("avg_sizes"),
            count_if(promo).alias("in_promo"),
            avg_rounded(F.col("competitor_markdown"), 0, promo).alias("avg_markdown"),
        )
    )
    return found.orderBy(F.desc("count"), "franchise", "marca", F.asc_nulls_first("division")).limit(limit)


def silhouettes(pricing: DataFrame, params: SilhouetteParams = SilhouetteParams()) -> DataFrame:
    beat, _, lose, _ = position_counts(F.col("bml_final_price"), null_as_nd=True)
    found = pricing.where(params.predicate()).groupBy("silueta", "marca").agg(F.count("*").alias("count"), avg_rounded(_price(), 0).alias("avg_price"), beat, lose)
    return found.orderBy(F.desc("count"), "silueta", "marca")


# The columns of the product listing, in order.
PRODUCT_COLUMNS = [
    "id", "fecha_corrida", "scraper", "canal", "marca", "season", "style_color", "productcode_competitor",
    "product_name_competitor", "marketing_name", "category_competitor", "division_competitor", "franchise_competitor",
    "gender_competitor", "silueta", "size_available_competitor", "text_sizes_competitor", "competitor_full_price",
    "competitor_markdown", "competitor_final_price", "competitor_shipping", "nike_full_price", "nike_final_price",
    "gap_final_price_pct", "gap_full_price_pct", "bml_final_price", "bml_full_price", "bml_vs_nikear",
    "link_pdp_competitor", "precio_sugerido", "fx_ars_usd", "competitor_price_usd",
]


def _listing(pricing: DataFrame, params: ProductParams) -> tuple[DataFrame, list[Column]]:
    rows = pricing.where(params.predicate()).select(*PRODUCT_COLUMNS)
    rest = [F.asc_nulls_first(c) for c in PRODUCT_COLUMNS if c != "competitor_final_price"]
    return rows, [F.desc_nulls_last("competitor_final_price"), *rest]


#: Rows up to a page's end from which it is found by histograms, not by a sort of all before it.
DEEP = 10_000


def product_page(pricing: DataFrame, params: ProductParams = ProductParams()) -> DataFrame:
    """One page of products, dearest first, products without a price last."""
    size = min(100, params.page_size)
    skip = (max(1, params.page) - 1) * size
    if skip + size > DEEP:
        return deep_page(pricing, params)
    rows, order = _listing(pricing, params)
    return rows.orderBy(*order).offset(skip).limit(size)


def deep_page(pricing: DataFrame, params: ProductParams, held: int = paging.HELD) -> DataFrame:
    """The same page however far down it is: a few counting scans, then a sort of at
    most ``held`` rows (of more only if they share price and id)."""
    size = min(100, params.page_size)
    rows, order = _listing(pricing, params)
    keys = [paging.Key("competitor_final_price", -(_price() * 100).cast("long"), True), paging.Key("id", F.col("id").cast("long"), False)]
    return paging.page(rows, keys, order, (max(1, params.page) - 1) * size, size, held)


def product_total(pricing: DataFrame, params: ProductParams = ProductParams()) -> DataFrame:
    return pricing.where(params.predicate()).agg(F.count("*").alias("total"))


def page_envelope(total: int, page: int = 1, page_size: int = 50) -> dict[str, int]:
    """The page's numbers as the listing reports them."""
    page, size = max(1, page), min(100, page_size)
    if size < 1:
        raise ValueError("page size must be positive")
    return {"total": total, "page": page, "pageSize": size, "totalPages": math.ceil(total / size)}


def pvp_by_retailer(pricing: DataFrame, names: Names = NAMES) -> DataFrame:
    """How resellers keep to the suggested price of the own brand. Compliant: within
    5 % either way; a suggested price of 0 is neither kept nor an error."""
    price, pvp = _price(), F.col("precio_sugerido")
    within = (pvp != 0) & (F.abs(price - pvp) <= F.abs(pvp) * F.lit(BAND))
    found = (
        pricing.where((F.col("marca") == names.own) & ~F.col("scraper").isin(*names.not_resellers))
        .groupBy("scraper")
        .agg(
            F.count("*").alias("total"),
            F.count(pvp).alias("with_pvp"),
            count_if(within).alias("compliant"),
            count_if(price < pvp * F.lit(LOW)).alias("below_pvp"),
            count_if(price > pvp * F.lit(HIGH)).alias("above_pvp"),
            avg_rounded(price, 0).alias("avg_price"),
            avg_rounded(pvp, 0).alias("avg_pvp"),
        )
    )
    share = F.when(F.col("with_pvp") > 0, share_pct(F.col("compliant"), F.col("with_pvp")))
    return found.withColumn("compliance_pct", share.cast("long")).orderBy(F.desc("total"), "scraper")


def pvp_violations(pricing: DataFrame, names: Names = NAMES, limit: int = TOP_LIST) -> DataFrame:
    """The deepest cuts below 95 % of the suggested price, direct feeds included."""
    price, pvp = _price(), F.col("precio_sugerido")
    found = pricing.where((F.col("marca") == names.own) & pvp.isNotNull() & (price < pvp * F.lit(LOW)) & ~F.col("scraper").isin(*names.own_feeds)).select(
        "scraper", "style_color", "marketing_name", "franchise_scrapper", "competitor_final_price", "precio_sugerido",
        rounded(ratio(price - pvp, pvp) * 100, 1).alias("diff_pct"), "link_pdp_competitor",
    )
    rest = [F.asc_nulls_first(c) for c in found.columns if c != "diff_pct"]
    return found.orderBy(F.asc_nulls_last("diff_pct"), *rest).limit(limit)


def _markdown(pricing: DataFrame, keys: list[str], names: Names) -> DataFrame:
    cut, full = F.col("competitor_markdown"), F.col("competitor_full_price")
    promo = cut > 0
    found = (
        pricing.where(~F.col("scraper").isin(*names.not_resellers))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("total"),
            count_if(promo).alias("in_promo"),
            avg_rounded(cut, 0, promo).alias("avg_markdown_abs"),
            avg_ratio(ratio(cut * 100, full), 1, promo).alias("avg_markdown_pct"),
        )
    )
    return found.select(*keys, "total", "in_promo", pct(F.col("in_promo"), F.col("total")).alias("promo_pct"), "avg_markdown_abs", "avg_markdown_pct")


def markdown_by_retailer(pricing: DataFrame, names: Names = NAMES) -> DataFrame:
    return _markdown(pricing, ["scraper", "marca"], names).orderBy(F.desc("promo_pct"), "scraper", F.asc_nulls_first("marca"))


def markdown_by_brand(pricing: DataFrame, names: Names = NAMES) -> DataFrame:
    return _markdown(pricing, ["marca"], names).drop("avg_markdown_abs").orderBy(F.desc("promo_pct"), F.asc_nulls_first("marca"))


def top_markdowns(pricing: DataFrame, names: Names = NAMES, limit: int = TOP_LIST) -> DataFrame:
    cut, full = F.col("competitor_markdown"), F.col("competitor_full_price")
    found = pricing.where((cut > 0) & (full > 0) & ~F.col("scraper").isin(*names.own_feeds)).select(
        "scraper", "marca", "style_color", "product_name_competitor", "franchise_competitor", "silueta", "competitor_full_price",
        "competitor_final_price", "competitor_markdown", rounded(ratio(cut * 100, full), 1).alias("markdown_pct"),
        "bml_final_price", "link_pdp_competitor",
    )
    rest = [F.asc_nulls_first(c) for c in found.columns if c != "markdown_pct"]
    return found.orderBy(F.desc("markdown_pct"), *rest).limit(limit)
