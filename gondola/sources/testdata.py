"""The star tables and the event table seen as the price and the shelf table.

Every column is one expression that Spark and DuckDB read alike, so that the
queries and their SQL start from equal rows. Nulls and odd values that the tables
lack are set by the sizes and keys of parts, suppliers and events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FULL = "cast(l_extendedprice as decimal(12,2))"
_CUT = "cast(l_discount as decimal(4,2))"
_FINAL = f"cast({_FULL} * (1 - {_CUT}) as decimal(12,2))"
_OWN = "cast(cast(p_retailprice as decimal(12,2)) * cast(l_quantity as decimal(6,0)) as decimal(12,2))"

PRICING = {
    "id": "l_orderkey * 10 + l_linenumber",
    "fecha_corrida": "cast(l_shipdate as date)",
    "scraper": "case s_suppkey % 20 when 0 then 'ADIDAS_7' when 1 then 'Puma_AR' when 2 then 'URU' when 3 then 'XAdidasPumaX' when 4 then 'nike_ar_general' when 5 then null else s_name end",
    "canal": "s_name",
    "marca": "case l_returnflag when 'A' then 'NIKE' when 'N' then 'ADIDAS' else 'Puma' end",
    "season": "case when p_size % 2 = 0 then 'SS' else 'FW' end",
    "style_color": "concat('SC', cast(p_partkey as string))",
    "marketing_name": "concat('M ', p_name)",
    "franchise_scrapper": "p_type",
    "productcode_competitor": "case when p_size % 6 = 0 then null else concat('P', cast(p_partkey as string)) end",
    "product_name_competitor": "case when p_size % 9 = 0 then null else p_name end",
    "category_competitor": "p_type",
    "division_competitor": "case p_size % 4 when 0 then 'FOOTWEAR' when 1 then 'Apparel' when 2 then 'equip' else null end",
    "franchise_competitor": "case p_brand when 'Brand#1' then '' when 'Brand#2' then null else p_brand end",
    "gender_competitor": "case when p_size % 3 = 0 then 'MEN' else 'WOMEN' end",
    "size_available_competitor": "p_size",
    "competitor_full_price": f"case when p_size % 19 = 0 then cast(0 as decimal(12,2)) else {_FULL} end",
    "competitor_markdown": f"case when p_size % 23 = 0 then null else cast({_FULL} * {_CUT} as decimal(12,2)) end",
    "competitor_final_price": f"case when p_size % 29 = 0 then null else {_FINAL} end",
    "nike_final_price": _OWN,
    "gap_final_price_pct": f"cast(cast(cast({_FINAL} as double) / cast({_OWN} as double) - 1 as decimal(28,10)) as decimal(10,6))",
    "bml_final_price": f"case when p_size % 11 = 0 then null when p_size % 13 = 0 then 'N/D' when p_size % 5 = 0 then null when {_FINAL} < {_OWN} * 0.95 then 'BEAT' when {_FINAL} <= {_OWN} * 1.05 then 'MEET' else 'LOSE' end",
    "precio_sugerido": f"case when p_size % 5 = 0 then null else {_OWN} end",
    "link_pdp_competitor": "concat('https://shop/', cast(p_partkey as string))",
    "silueta": "case when p_size % 31 = 0 then '' else p_type end",
}
EMPTY = {
    "text_sizes_competitor": "string", "competitor_shipping": "decimal(12,2)", "nike_full_price": "decimal(12,2)", "gap_full_price_pct": "decimal(10,6)",
    "bml_full_price": "string", "bml_vs_nikear": "string", "fx_ars_usd": "decimal(12,4)", "competitor_price_usd": "decimal(12,4)",
}
SHELF = {
    "id": "event_id",
    "canal": "event_type",
    "search_term": "concat('term', cast(user_id % 40 as string))",
    "marca": "case when event_id % 97 = 0 then 'Topper' when event_id % 3 = 0 then 'Nike' when event_id % 3 = 1 then 'Adidas' else 'Puma' end",
    "nike_visibility": "case when event_id % 17 = 0 then null else value end",
}


def _columns() -> list[str]:
    return [f"{e} as {c}" for c, e in PRICING.items()] + [f"cast(null as {kind}) as {c}" for c, kind in EMPTY.items()]


def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts, suppliers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part", "supplier"))
    # sizes decide: Spark broadcasts a side by its statistics, else sorts and merges
    return lines.join(parts, lines.l_partkey == parts.p_partkey).join(suppliers, lines.l_suppkey == suppliers.s_suppkey).selectExpr(*_columns())


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{e} as {c}" for c, e in SHELF.items()])


#: The same rows for SQL: to be followed by the question.
PRICING_SQL = f"with pricing as (select {', '.join(_columns())} from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey) "
SHELF_SQL = f"with shelf as (select {', '.join(f'{e} as {c}' for c, e in SHELF.items())} from events) "
