"""The answers as users see them: one JSON body for each response.

The five statements of each summary are one scan: of prices grouped by brand and
franchise, of searches by channel and term. Other bodies scan once for each list. An error is an exception, not a body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.exprs import EXACT, half_up, position_counts, present, rounded
from gondola.operators import pricing as price
from gondola.operators import shelf as shelves
from gondola.operators.filters import FranchiseParams, ProductParams, SilhouetteParams
from gondola.schema import NAMES, Names


def summary_parts(pricing: DataFrame, names: Names = NAMES, top: int = price.TOP_BRAND) -> DataFrame:
    """One row with the parts of the price summary: kpis, bml_adidas, bml_puma, top_adidas
    and top_puma, as Q01 to Q05 give them one by one."""
    cents, gap, label = F.col("competitor_final_price"), F.col("gap_final_price_pct"), F.col("bml_final_price")
    by = [F.count("*").alias("n"), F.sum(cents).alias("s"), F.count(cents).alias("c"), F.sum(gap).alias("gs"), F.count(gap).alias("gc"), *position_counts(label, null_as_nd=True)]
    base = pricing.where(F.col("marca").isin(*names.brands)).groupBy("marca", F.col("franchise_competitor").alias("franchise")).agg(*by)
    order = Window.partitionBy("marca").orderBy(F.desc_nulls_last(F.when(present("franchise"), F.col("n"))), "franchise")
    ranked = base.withColumn("place", F.row_number().over(order))
    mean = lambda s, c, digits: rounded(F.col(s).cast("double") / F.nullif(c, F.lit(0)), digits)
    line = F.struct("place", "franchise", F.col("n").alias("count"), mean("s", "c", 0).alias("avg_price"), mean("gs", "gc", 4).alias("avg_gap_pct"))

    def total(column: str, brand: str | None = None) -> Column:
        return F.coalesce(F.sum(F.when(F.col("marca") == brand, F.col(column)) if brand else F.col(column)), F.lit(0))

    def average(brand: str) -> Column:
        mine = F.col("marca") == brand
        return rounded(F.sum(F.when(mine, F.col("s"))).cast("double") / F.nullif(F.sum(F.when(mine, F.col("c"))), F.lit(0)), 0)

    def first(brand: str) -> Column:
        lines = F.sort_array(F.collect_list(F.when((F.col("marca") == brand) & (F.col("place") <= top) & present("franchise"), line)))
        return F.transform(lines, lambda x: x.dropFields("place"))

    positions = ("beat", "meet", "lose", "nd")
    kpis = [total("n", names.rival).alias("adidas_total"), total("n", names.second).alias("puma_total"), total("n", names.own).alias("nike_total"), average(names.rival).alias("adidas_avg_price"), average(names.second).alias("puma_avg_price"), *[total(p).alias(f"total_{p}") for p in positions]]
    shares = lambda brand: F.struct(*[total(p, brand).alias(p) for p in positions])
    return ranked.agg(
        F.struct(*kpis).alias("kpis"), shares(names.rival).alias("bml_adidas"), shares(names.second).alias("bml_puma"),
        first(names.rival).alias("top_adidas"), first(names.second).alias("top_puma"),
    )


def body(parts: DataFrame) -> DataFrame:
    """A one-row table as its JSON text; null fields are written."""
    return parts.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))


def pricing_summary(pricing: DataFrame, names: Names = NAMES) -> DataFrame:
    return body(summary_parts(pricing, names))


def products(pricing: DataFrame, params: ProductParams = ProductParams()) -> DataFrame:
    """The page's rows with total, page, pageSize and totalPages."""
    page = price.product_page(pricing, params)
    listed = _in_order(page, "products")
    total = price.product_total(pricing, params)
    both = listed.unionByName(total, allowMissingColumns=True).agg(F.first("products", ignorenulls=True).alias("products"), F.max("total").alias("total"))
    return body(both.select("products", "total", *page_numbers(F.col("total"), params)))


def page_numbers(total: Column, params: ProductParams) -> list[Column]:
    """What ``pricing.page_envelope`` says, of a total that is a column."""
    known = price.page_envelope(0, params.page, params.page_size)
    pages = F.ceil(total / known["pageSize"]).cast("long")
    return [F.lit(known["page"]).alias("page"), F.lit(known["pageSize"]).alias("pageSize"), pages.alias("totalPages")]


def _in_order(rows: DataFrame, name: str) -> DataFrame:
    """One row: the rows, which are sorted and few, as a list."""
    line = F.struct(F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(c) for c in rows.columns]).alias("line"))
    return rows.select(line.alias("x")).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]).alias(name))


def _joined(*lists: DataFrame) -> DataFrame:
    """One row of one-row tables of one column each."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.agg(*[F.first(x.columns[0], ignorenulls=True).alias(x.columns[0]) for x in lists])


def franchises(pricing: DataFrame, params: FranchiseParams = FranchiseParams()) -> DataFrame:
    return body(_in_order(price.franchises(pricing, params), "franchises"))


def silhouettes(pricing: DataFrame, params: SilhouetteParams = SilhouetteParams()) -> DataFrame:
    return body(_in_order(price.silhouettes(pricing, params), "siluetas"))


def pvp_compliance(pricing: DataFrame, names: Names = NAMES) -> DataFrame:
    return body(_joined(_in_order(price.pvp_by_retailer(pricing, names), "retailers"), _in_order(price.pvp_violations(pricing, names), "violations")))


def markdown_analysis(pricing: DataFrame, names: Names = NAMES) -> DataFrame:
    by_retailer, by_brand, top = (f(pricing, names) for f in (price.markdown_by_retailer, price.markdown_by_brand, price.top_markdowns))
    return body(_joined(_in_order(by_retailer, "by_retailer"), _in_order(by_brand, "by_marca"), _in_order(top, "top_markdowns")))


def shelf_parts(shelf: DataFrame, names: Names = NAMES) -> DataFrame:
    """One row with the parts of the shelf summary, as Q17 to Q22 give them one by one,
    from one scan: a row for each channel and term holds the term's winner and what
    each brand adds to its mean, and all parts are sums of these rows."""
    seen, exact = F.col("nike_visibility"), F.col("nike_visibility").cast(EXACT)
    place = F.when(F.isnan(seen), F.lit(float("-inf"))).otherwise(-seen)
    brands = [b.lower() for b in names.shelf]
    sums = [x for b, c in zip(names.shelf, brands, strict=True) for x in (F.sum(F.when(F.col("marca") == b, exact)).alias(f"s_{c}"), F.count(F.when(F.col("marca") == b, seen)).alias(f"n_{c}"))]
    terms = shelf.groupBy("canal", "search_term").agg(F.min(F.when(seen.isNotNull(), F.struct(place.alias("place"), "marca"))).alias("best"), *sums)
    more = [F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in brands for k in "sn"]
    won = terms.groupBy("canal", F.col("best.marca").alias("marca")).agg(F.count("*").alias("wins"), F.count("search_term").alias("terms"), *more)
    line = F.when(F.col("marca").isNotNull(), F.struct((-F.col("wins")).alias("w"), "marca", "wins"))
    by_channel = won.groupBy("canal").agg(F.sum("terms").alias("total"), F.sort_array(F.collect_list(line)).alias("lines"), *more)
    of = F.coalesce(F.nullif("total", F.lit(0)), F.lit(1))
    pct = lambda x: (half_up(x["wins"] / of * 1000) / 10).cast("double")
    by_channel = by_channel.withColumn("won", F.transform("lines", lambda x: F.struct(x["marca"].alias("marca"), x["wins"].alias("wins"), pct(x).alias("pct"))))
    mean = lambda c: (F.sum(f"s_{c}").cast("double") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).cast(EXACT).cast("double")
    mapped = lambda where, value: F.map_from_entries(F.sort_array(F.collect_list(F.when(where, F.struct("canal", value)))))
    means = [mean(c).alias(c) for c in brands]
    return by_channel.agg(mapped(F.size("won") > 0, "won").alias("byCanal"), F.struct(*means, F.coalesce(F.sum(f"n_{brands[0]}"), F.lit(0)).alias("n")).alias("global"), mapped(F.lit(True), "total").alias("totalByCanal"))


def shelf_summary(shelf: DataFrame, names: Names = NAMES) -> DataFrame:
    """Each channel's winners, the brands' visibility, and the terms of each channel."""
    return body(shelf_parts(shelf, names))


def search_lines(shelf: DataFrame, canal: str = "") -> DataFrame:
    """The search table's rows, a JSON text each: as many as there are searches. A
    brand that was not seen has no field."""
    return shelves.search_table(shelf, canal).select("canal", "search_term", F.to_json(F.struct("*")).alias("body")).orderBy("canal", "search_term").select("body")


def shelf_searches(shelf: DataFrame, canal: str = "") -> DataFrame:
    """The same as one body, for one reader: {"rows": [...]}, by channel and term."""
    rows = shelves.search_table(shelf, canal).orderBy("canal", "search_term")
    return _in_order(rows, "rows").select(F.to_json(F.struct("rows")).alias("body"))
