"""Optional parameters to one predicate. Absent and empty mean no filter."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions.exprs import like_pattern, present
from gondola.schema import NAMES, Names


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equal(column: str, value: str | None) -> list[Column]:
    return [F.col(column) == value] if value else []


def contains(columns: Iterable[str], text: str | None) -> list[Column]:
    """The text, in any case, in one of the columns at least."""
    if not text:
        return []
    pattern = like_pattern(text)
    return [reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns])]


def channel(value: str | None, direct: tuple[str, ...], names: Names = NAMES) -> list[Column]:
    """d2c: the direct feeds; b2b: the resellers; anything else: all."""
    feed = F.col("scraper")
    return {"d2c": [feed.isin(*direct)], "b2b": [~feed.isin(*names.not_resellers)]}.get(value or "", [])


@dataclass(frozen=True)
class FranchiseParams:
    marca: str = ""
    division: str = ""
    category: str = ""
    gender: str = ""
    canal: str = ""

    def predicate(self, names: Names = NAMES) -> Column:
        brand = equal("marca", self.marca) or [F.col("marca").isin(*names.rivals)]
        division = [F.upper("division_competitor").like(like_pattern(self.division.upper()))] if self.division else []
        return all_of(
            [
                present("franchise_competitor"),
                *brand,
                *division,
                *equal("category_competitor", self.category),
                *equal("gender_competitor", self.gender),
                *channel(self.canal, names.direct_franchises, names),
            ]
        )


@dataclass(frozen=True)
class SilhouetteParams:
    marca: str = ""

    def predicate(self, names: Names = NAMES) -> Column:
        brand = equal("marca", self.marca) or [F.col("marca").isin(*names.rivals)]
        return all_of([present("silueta"), *brand])


@dataclass(frozen=True)
class ProductParams:
    marca: str = ""
    franchise: str = ""
    silueta: str = ""
    category: str = ""
    bml: str = ""
    gender: str = ""
    scraper: str = ""
    search: str = ""
    canal: str = ""
    page: int = 1
    page_size: int = 50

    def predicate(self, names: Names = NAMES) -> Column:
        return all_of(
            [
                *equal("marca", self.marca),
                *contains(["franchise_competitor"], self.franchise),
                *equal("silueta", self.silueta),
                *equal("category_competitor", self.category),
                *equal("bml_final_price", self.bml),
                *equal("gender_competitor", self.gender),
                *equal("scraper", self.scraper),
                *contains(["product_name_competitor", "style_color", "franchise_competitor"], self.search),
                *channel(self.canal, names.direct_products, names),
            ]
        )
