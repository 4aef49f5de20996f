"""Share of shelf: which brand a retailer's search shows first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.exprs import EXACT, half_up
from gondola.schema import NAMES, Names


def winners(shelf: DataFrame) -> DataFrame:
    """Terms won by channel and brand: the brand with the best visibility of all its
    rows wins a term, of equals the first by name."""
    best = Window.partitionBy("canal", "search_term").orderBy(F.desc_nulls_last("nike_visibility"), "marca")
    first = shelf.where(F.col("nike_visibility").isNotNull()).select("canal", "search_term", "marca", "nike_visibility").withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return first.groupBy("canal", "marca").agg(F.count("*").alias("wins"))


def term_totals(shelf: DataFrame) -> DataFrame:
    """Distinct terms by channel, those that nobody wins included."""
    return shelf.groupBy("canal").agg(F.countDistinct("search_term").alias("total"))


def shelf_shares(shelf: DataFrame) -> DataFrame:
    """Winners with their share of the channel's terms, in percent."""
    joined = winners(shelf).join(term_totals(shelf), "canal", "left")
    total = F.coalesce(F.nullif("total", F.lit(0)), F.lit(1))
    return joined.select("canal", "marca", "wins", (half_up(F.col("wins") / total * 1000) / 10).cast("double").alias("pct"))


def brand_visibility(shelf: DataFrame, brand: str, counted: bool = False) -> DataFrame:
    """One row: the average visibility of a brand, and over how many rows."""
    x = F.col("nike_visibility").cast(EXACT)
    rows = shelf.where((F.col("marca") == brand) & F.col("nike_visibility").isNotNull())
    mean = (F.sum(x).cast("double") / F.nullif(F.count(x), F.lit(0))).cast(EXACT).cast("double")
    return rows.agg(mean.alias("avg_visibility"), *([F.count("*").alias("n")] if counted else []))


def searches(shelf: DataFrame, canal: str = "") -> DataFrame:
    rows = shelf.where(F.col("nike_visibility").isNotNull())
    rows = rows.where(F.col("canal") == canal) if canal else rows
    return rows.select("canal", "search_term", "marca", "nike_visibility").orderBy("canal", "search_term", F.desc("nike_visibility"), "marca")


def search_table(shelf: DataFrame, canal: str = "", names: Names = NAMES) -> DataFrame:
    """One row for each channel and term with the lowest visibility of the three
    brands, and the best of them; of equals the first, and the first too where
    none of the three was seen."""
    cols = [b.lower() for b in names.shelf]
    rows = shelf.where(F.col("nike_visibility").isNotNull())
    rows = rows.where(F.col("canal") == canal) if canal else rows
    seen = rows.groupBy("canal", "search_term").agg(*[F.min(F.when(F.lower("marca") == c, F.col("nike_visibility"))).alias(c) for c in cols])
    best = F.greatest(*[F.coalesce(c, F.lit(-1.0)) for c in cols])
    winner = F.lit(names.shelf[-1])
    for brand, c in reversed(list(zip(names.shelf[:-1], cols[:-1], strict=True))):
        winner = F.when(F.coalesce(c, F.lit(-1.0)) == best, brand).otherwise(winner)
    return seen.withColumn("winner", winner)
