"""The three stored views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.exprs import avg_rounded, count_if, pct, position_counts, present
from gondola.schema import NAMES, Names


def bml_summary(pricing: DataFrame) -> DataFrame:
    """Price position by feed and brand; rows without a label count only in total."""
    return pricing.groupBy("scraper", "marca").agg(
        F.count("*").alias("total"),
        *position_counts(F.col("bml_final_price"), null_as_nd=False),
        avg_rounded(F.col("competitor_final_price"), 0).alias("avg_price"),
        avg_rounded(F.col("gap_final_price_pct"), 4).alias("avg_gap_pct"),
    )


def franchise_summary(pricing: DataFrame) -> DataFrame:
    keys = [F.col("franchise_competitor").alias("franchise"), "marca", F.col("division_competitor").alias("division")]
    grouped = pricing.where(present("franchise_competitor")).groupBy(*keys)
    return grouped.agg(
        F.count("*").alias("total_skus"),
        avg_rounded(F.col("competitor_final_price"), 0).alias("avg_price"),
        avg_rounded(F.col("gap_final_price_pct"), 4).alias("avg_gap_pct"),
        *position_counts(F.col("bml_final_price"), null_as_nd=False)[:3],
        avg_rounded(F.col("size_available_competitor"), 1).alias("avg_sizes"),
    )


def shelf_share(pricing: DataFrame, names: Names = NAMES) -> DataFrame:
    """Each brand's share of the products that a reseller lists."""
    feed = F.col("scraper")
    counted = (
        pricing.where(~feed.like(names.combined_feed) & ~feed.isin(*names.not_resellers))
        .groupBy("scraper")
        .agg(
            count_if(F.col("marca") == names.own).alias("nike_count"),
            count_if(F.col("marca") == names.rival).alias("adidas_count"),
            count_if(F.col("marca") == names.second).alias("puma_count"),
            F.count("*").alias("total"),
        )
    )
    return counted.select("*", *[pct(F.col(f"{b}_count"), F.col("total")).alias(f"{b}_share_pct") for b in ("nike", "adidas", "puma")])
