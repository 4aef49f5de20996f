"""Views and shelf questions from states that loads keep up, equal to their full forms.

One state of each table serves them all: prices by feed, brand, franchise and division
(a group for each in the catalogue, whatever the number of rows), searches by channel,
term and brand. The latter is itself a small shelf table: the best visibility of a
brand decides winners, every term stands in it (distinct terms are exact, without a
dictionary of terms), so that the questions of ``shelf`` run on it as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.exprs import EXACT, pct, position_counts, present, rounded
from gondola.operators import shelf as shelves
from gondola.schema import NAMES, PRICING, SHELF, Names
from gondola.sources.states import State

_POSITIONS = ("beat", "meet", "lose", "nd")
_MEANS = {"price": "competitor_final_price", "gap": "gap_final_price_pct", "sizes": "size_available_competitor"}


def _price_parts() -> dict[str, Column]:
    label = dict(zip(_POSITIONS, position_counts(F.col("bml_final_price"), null_as_nd=False), strict=True))
    sums = {f"{k}_sum": F.sum(c) for k, c in _MEANS.items()} | {f"{k}_n": F.count(c) for k, c in _MEANS.items()}
    return {"n": F.count("*")} | label | sums


def _shelf_parts() -> dict[str, Column]:
    x = F.col("nike_visibility")
    return {"best": F.max(x), "lowest": F.min(x), "seen_sum": F.sum(x.cast(EXACT)), "seen_n": F.count(x)}


PRICE_STATE = State(
    "prices", PRICING, ("scraper", "marca", "franchise_competitor", "division_competitor"),
    dict.fromkeys(("n", *_POSITIONS, *[f"{k}_{p}" for k in _MEANS for p in ("sum", "n")]), "sum"), _price_parts,
)
SHELF_STATE = State("searches", SHELF, ("canal", "search_term", "marca"), {"best": "max", "lowest": "min", "seen_sum": "sum", "seen_n": "sum"}, _shelf_parts)


def _total(c: str) -> Column:
    return F.sum(c).cast("long")


def _mean(c: str, digits: int) -> Column:
    return rounded(F.sum(f"{c}_sum").cast("double") / F.nullif(F.sum(f"{c}_n"), F.lit(0)), digits)


def bml_summary(prices: DataFrame) -> DataFrame:
    return prices.groupBy("scraper", "marca").agg(_total("n").alias("total"), *[_total(p).alias(p) for p in _POSITIONS], _mean("price", 0).alias("avg_price"), _mean("gap", 4).alias("avg_gap_pct"))


def franchise_summary(prices: DataFrame) -> DataFrame:
    keys = [F.col("franchise_competitor").alias("franchise"), "marca", F.col("division_competitor").alias("division")]
    return prices.where(present("franchise_competitor")).groupBy(*keys).agg(
        _total("n").alias("total_skus"), _mean("price", 0).alias("avg_price"), _mean("gap", 4).alias("avg_gap_pct"), *[_total(p).alias(p) for p in _POSITIONS[:3]], _mean("sizes", 1).alias("avg_sizes")
    )


def shelf_share(prices: DataFrame, names: Names = NAMES) -> DataFrame:
    feed = F.col("scraper")
    brands = {"nike": names.own, "adidas": names.rival, "puma": names.second}
    counted = prices.where(~feed.like(names.combined_feed) & ~feed.isin(*names.not_resellers)).groupBy("scraper").agg(
        *[F.coalesce(F.sum(F.when(F.col("marca") == brand, F.col("n"))), F.lit(0)).cast("long").alias(f"{b}_count") for b, brand in brands.items()], _total("n").alias("total")
    )
    return counted.select("*", *[pct(F.col(f"{b}_count"), F.col("total")).alias(f"{b}_share_pct") for b in brands])


def as_shelf(searches: DataFrame, value: str = "best") -> DataFrame:
    """The state as rows of the shelf table, with the best or the lowest visibility."""
    return searches.select("canal", "search_term", "marca", F.col(value).alias("nike_visibility"))


def winners(searches: DataFrame) -> DataFrame:
    return shelves.winners(as_shelf(searches))


def term_totals(searches: DataFrame) -> DataFrame:
    return shelves.term_totals(as_shelf(searches))


def shelf_shares(searches: DataFrame) -> DataFrame:
    return shelves.shelf_shares(as_shelf(searches))


def search_table(searches: DataFrame, canal: str = "", names: Names = NAMES) -> DataFrame:
    return shelves.search_table(as_shelf(searches, "lowest"), canal, names)


def brand_visibility(searches: DataFrame, brand: str, counted: bool = False) -> DataFrame:
    mean = (F.sum("seen_sum").cast("double") / F.nullif(F.sum("seen_n"), F.lit(0))).cast(EXACT).cast("double").alias("avg_visibility")
    return searches.where(F.col("marca") == brand).agg(mean, *([F.coalesce(_total("seen_n"), F.lit(0)).alias("n")] if counted else []))
