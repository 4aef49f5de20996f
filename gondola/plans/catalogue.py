"""Every question by its key, over the test tables, and the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions.exprs import position_counts
from gondola.operators import kept
from gondola.operators import present as show
from gondola.operators import pricing as price
from gondola.operators import responses, search
from gondola.operators import shelf as shelves
from gondola.operators import views
from gondola.operators.filters import FranchiseParams, ProductParams, SilhouetteParams
from gondola.schema import NAMES
from gondola.sources.states import State
from gondola.sources.testdata import PRICING_SQL, SHELF_SQL, pricing, shelf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_RUNS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, for comparison across engines."""
    kinds = {c: "double" if t.startswith("decimal") else "string" if t == "date" else None for c, t in df.dtypes}
    return df.select(*[F.col(c).cast(k) if k else F.col(c) for c, k in kinds.items()])


def _add(key: str, source: Callable, run: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    _RUNS[key] = run
    QUERIES[key] = lambda spark, sf_dir: plain(run(source(spark, sf_dir)))
    if sql:
        ORACLES[key] = (PRICING_SQL if source is pricing else SHELF_SQL) + sql


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _avg(x: str, n: int, where: str = "") -> str:
    """The exact average of x, rounded."""
    x = f"case when {where} then {x} end" if where else x
    return f"cast(round(cast(cast(sum({x}) as double) / nullif(count({x}), 0) as decimal(28,10)), {n}) as double)"


def _round(x: str, n: int) -> str:
    return f"cast(round(cast({x} as decimal(28,10)), {n}) as double)"


def _if(where: str) -> str:
    return f"count(case when {where} then 1 end)"


def _positions(null_as_nd: bool, prefix: str = "") -> str:
    nd = "bml_final_price not in ('BEAT', 'MEET', 'LOSE')" + (" or bml_final_price is null" if null_as_nd else "")
    kinds = ", ".join(f"{_if(f"bml_final_price = '{p}'")} as {prefix}{p.lower()}" for p in ("BEAT", "MEET", "LOSE"))
    return f"{kinds}, {_if(nd)} as {prefix}nd"


OWN, RIVAL, SECOND = NAMES.own, NAMES.rival, NAMES.second
R7, R5, RIVALS = _in(NAMES.not_resellers), _in(NAMES.own_feeds), _in(NAMES.rivals)
AVG_PRICE = f"{_avg('competitor_final_price', 0)} as avg_price"
AVG_GAP = f"{_avg('gap_final_price_pct', 4)} as avg_gap_pct"
HAS_FRANCHISE = "franchise_competitor <> ''"

# views
_add("V01_bml_summary", pricing, views.bml_summary, f"select scraper, marca, count(*) as total, {_positions(False)}, {AVG_PRICE}, {AVG_GAP} from pricing group by all")
_add(
    "V02_franchise_summary", pricing, views.franchise_summary,
    f"select franchise_competitor as franchise, marca, division_competitor as division, count(*) as total_skus, {AVG_PRICE}, {AVG_GAP}, {_positions(False).rpartition(', count')[0]}, {_avg('size_available_competitor', 1)} as avg_sizes from pricing where {HAS_FRANCHISE} group by all",
)
_COUNTS = ", ".join(f"{_if(f"marca = '{b}'")} as {c}_count" for c, b in (("nike", OWN), ("adidas", RIVAL), ("puma", SECOND)))
_SHARES = ", ".join(f"{_round(f'cast({b}_count as double) * 100 / total', 1)} as {b}_share_pct" for b in ("nike", "adidas", "puma"))
_add("V03_shelf_share", pricing, views.shelf_share, f"select *, {_SHARES} from (select scraper, {_COUNTS}, count(*) as total from pricing where scraper not like '%AdidasPuma%' and scraper not in {R7} group by scraper)")

# summary
_KPIS = f"""select {_if(f"marca = '{RIVAL}'")} as adidas_total, {_if(f"marca = '{SECOND}'")} as puma_total, {_if(f"marca = '{OWN}'")} as nike_total,
{_avg('competitor_final_price', 0, f"marca = '{RIVAL}'")} as adidas_avg_price, {_avg('competitor_final_price', 0, f"marca = '{SECOND}'")} as puma_avg_price, {_positions(True, 'total_')}
from pricing where marca in {_in(NAMES.brands)}"""
_add("Q01_summary_kpis", pricing, price.summary_kpis, _KPIS)
for _key, _brand in (("Q02_bml_rival", RIVAL), ("Q03_bml_second", SECOND)):
    _add(_key, pricing, lambda p, b=_brand: price.brand_positions(p, b), f"select {_positions(True)} from pricing where marca = '{_brand}'")
for _key, _brand in (("Q04_top_rival", RIVAL), ("Q05_top_second", SECOND)):
    _add(_key, pricing, lambda p, b=_brand: price.top_franchises(p, b), f'select franchise_competitor as franchise, count(*) as "count", {AVG_PRICE}, {AVG_GAP} from pricing where marca = \'{_brand}\' and {HAS_FRANCHISE} group by 1 order by 2 desc, 1 limit 10')


# franchises, silhouettes
def _franchises(where: str, limit: str = "limit 100") -> str:
    return f"""select franchise_competitor as franchise, marca, division_competitor as division, count(*) as "count", {AVG_PRICE}, {_avg('competitor_full_price', 0)} as avg_full_price, {AVG_GAP}, {_positions(True)},
{_avg('size_available_competitor', 1)} as avg_sizes, {_if('competitor_markdown > 0')} as in_promo, {_avg('competitor_markdown', 0, 'competitor_markdown > 0')} as avg_markdown
from pricing where {HAS_FRANCHISE} and {where} group by 1, 2, 3 order by 4 desc, 1, 2, 3 nulls first {limit}"""


_FRANCHISE_CASES = {
    "Q06_franchises": (FranchiseParams(), f"marca in {RIVALS}"),
    "Q06_franchises_b2b_division": (FranchiseParams(canal="b2b", division="foot"), f"marca in {RIVALS} and scraper not in {R7} and upper(division_competitor) like '%FOOT%'"),
    "Q06_franchises_d2c": (FranchiseParams(canal="d2c", marca=OWN), f"marca = '{OWN}' and scraper in {_in(NAMES.direct_franchises)}"),
    "Q06_franchises_category_gender": (FranchiseParams(category="ECONOMY", gender="MEN", canal="all"), f"marca in {RIVALS} and category_competitor = 'ECONOMY' and gender_competitor = 'MEN'"),
}
for _key, (_params, _where) in _FRANCHISE_CASES.items():
    _add(_key, pricing, lambda p, x=_params: price.franchises(p, x), _franchises(_where))
_SILHOUETTE = "select silueta, marca, count(*) as \"count\", {}, {} as beat, {} as lose from pricing where silueta <> '' and {} group by 1, 2"
for _key, _params, _where in (("Q07_silhouettes", SilhouetteParams(), f"marca in {RIVALS}"), ("Q07_silhouettes_own", SilhouetteParams(OWN), f"marca = '{OWN}'")):
    _add(_key, pricing, lambda p, x=_params: price.silhouettes(p, x), _SILHOUETTE.format(AVG_PRICE, _if("bml_final_price = 'BEAT'"), _if("bml_final_price = 'LOSE'"), _where))

# products
_PLAIN = {"fecha_corrida": "string"} | {c: "double" for c in ("competitor_full_price", "competitor_markdown", "competitor_final_price", "competitor_shipping", "nike_full_price", "nike_final_price", "gap_final_price_pct", "gap_full_price_pct", "precio_sugerido", "fx_ars_usd", "competitor_price_usd")}
_CELLS = ", ".join(f"cast({c} as {_PLAIN[c]}) as {c}" if c in _PLAIN else c for c in price.PRODUCT_COLUMNS)
_ORDER = "competitor_final_price desc nulls last, " + ", ".join(f"{c} nulls first" for c in price.PRODUCT_COLUMNS if c != "competitor_final_price")


def _page(where: str, limit: int = 50, offset: int | str = 0) -> str:
    inner = ", ".join(price.PRODUCT_COLUMNS)
    return f"select {_CELLS} from (select {inner} from pricing where {where} order by {_ORDER} limit {limit} offset {offset})"


_PRODUCT_CASES = {
    "all": (ProductParams(), "true"),
    "page_3_of_20": (ProductParams(page=3, page_size=20, marca=RIVAL), f"marca = '{RIVAL}'"),
    "size_over_100": (ProductParams(page=0, page_size=500, canal="b2b"), f"scraper not in {R7}"),
    "franchise_ilike": (ProductParams(franchise="rand#1_"), "franchise_competitor ilike '%rand#1_%'"),
    "search": (ProductParams(search="sc1%5"), "(product_name_competitor ilike '%sc1%5%' or style_color ilike '%sc1%5%' or franchise_competitor ilike '%sc1%5%')"),
    "equalities": (ProductParams(silueta="ECONOMY", category="ECONOMY", bml="LOSE", gender="MEN"), "silueta = 'ECONOMY' and category_competitor = 'ECONOMY' and bml_final_price = 'LOSE' and gender_competitor = 'MEN'"),
    "scraper": (ProductParams(scraper="URU"), "scraper = 'URU'"),
    "d2c": (ProductParams(canal="d2c"), f"scraper in {_in(NAMES.direct_products)}"),
}
for _name, (_params, _where) in _PRODUCT_CASES.items():
    _size = min(100, _params.page_size)
    _offset = (max(1, _params.page) - 1) * _size
    _add(f"Q08_products_{_name}", pricing, lambda p, x=_params: price.product_page(p, x), _page(_where, _size, _offset))
    _add(f"Q09_total_{_name}", pricing, lambda p, x=_params: price.product_total(p, x), f"select count(*) as total from pricing where {_where}")


def _far_page(p: DataFrame, params: ProductParams, of: Callable[[int], int]) -> DataFrame:
    """A page far down, its number from the total, found by histograms."""
    pages = price.page_envelope(price.product_total(p, params).first()["total"], 1, params.page_size)["totalPages"]
    return price.deep_page(p, replace(params, page=of(pages)), held=500)


for _name, _params, _where, _of, _sql_of in (
    ("last_page", ProductParams(), "true", lambda n: n, "n - 1"),
    ("middle_page", ProductParams(marca=RIVAL, page_size=20), f"marca = '{RIVAL}'", lambda n: n // 2, "n // 2 - 1"),
):
    _total = f"(select {_sql_of} from (select cast(ceil(count(*) / {_params.page_size}) as bigint) as n from pricing where {_where}))"
    _add(f"Q08_products_{_name}", pricing, lambda p, x=_params, f=_of: _far_page(p, x, f), _page(_where, _params.page_size, f"({_params.page_size} * {_total})"))


def _envelope(p: DataFrame) -> DataFrame:
    params = ProductParams(marca=RIVAL, page=3, page_size=20)
    return price.product_total(p, params).select("total", *responses.page_numbers(F.col("total"), params))


_add("Q10_envelope", pricing, _envelope, f"select count(*) as total, 3 as page, 20 as \"pageSize\", cast(ceil(count(*) / 20) as bigint) as \"totalPages\" from pricing where marca = '{RIVAL}'")

# suggested prices
_PVP = f"""select scraper, count(*) as total, count(precio_sugerido) as with_pvp, {_if('abs((competitor_final_price - precio_sugerido) / nullif(precio_sugerido, 0)) <= 0.05')} as compliant,
{_if('competitor_final_price < precio_sugerido * 0.95')} as below_pvp, {_if('competitor_final_price > precio_sugerido * 1.05')} as above_pvp, {AVG_PRICE}, {_avg('precio_sugerido', 0)} as avg_pvp
from pricing where marca = '{OWN}' and scraper not in {R7} group by scraper"""
_PCT = "case when with_pvp > 0 then cast(floor(compliant / with_pvp * 100 + 0.5) as bigint) end as compliance_pct"
_add("Q11_pvp_by_retailer", pricing, price.pvp_by_retailer, f"select *, {_PCT} from ({_PVP})")
_add("Q12_compliance_pct", pricing, lambda p: price.pvp_by_retailer(p).select("scraper", "compliance_pct"), f"select scraper, {_PCT} from ({_PVP})")
_DIFF = _round("cast(competitor_final_price - precio_sugerido as double) / cast(nullif(precio_sugerido, 0) as double) * 100", 1)
_VIOLATION = "scraper, style_color, marketing_name, franchise_scrapper, competitor_final_price, precio_sugerido, link_pdp_competitor"
_add(
    "Q13_pvp_violations", pricing, price.pvp_violations,
    f"""select * replace (cast(competitor_final_price as double) as competitor_final_price, cast(precio_sugerido as double) as precio_sugerido) from (select {_VIOLATION}, {_DIFF} as diff_pct from pricing
where marca = '{OWN}' and competitor_final_price < precio_sugerido * 0.95 and scraper not in {R5} order by diff_pct nulls last, {", ".join(f"{c} nulls first" for c in _VIOLATION.split(", "))} limit 100)""",
)

# markdowns
_RATIO = "cast(cast(competitor_markdown * 100 as double) / cast(nullif(competitor_full_price, 0) as double) as decimal(28,10))"
_PROMO = f"count(*) as total, {_if('competitor_markdown > 0')} as in_promo, {_round(f'cast({_if("competitor_markdown > 0")} as double) * 100 / count(*)', 1)} as promo_pct"
_DEPTH = f"{_avg(_RATIO, 1, 'competitor_markdown > 0')} as avg_markdown_pct"
_add("Q14_markdown_by_retailer", pricing, price.markdown_by_retailer, f"select scraper, marca, {_PROMO}, {_avg('competitor_markdown', 0, 'competitor_markdown > 0')} as avg_markdown_abs, {_DEPTH} from pricing where scraper not in {R7} group by scraper, marca")
_add("Q15_markdown_by_brand", pricing, price.markdown_by_brand, f"select marca, {_PROMO}, {_DEPTH} from pricing where scraper not in {R7} group by marca")
_TOP = "scraper, marca, style_color, product_name_competitor, franchise_competitor, silueta, competitor_full_price, competitor_final_price, competitor_markdown, bml_final_price, link_pdp_competitor"
_add(
    "Q16_top_markdowns", pricing, price.top_markdowns,
    f"""select * replace ({", ".join(f"cast({c} as double) as {c}" for c in ("competitor_full_price", "competitor_final_price", "competitor_markdown"))}) from (select {_TOP}, {_round("cast(competitor_markdown * 100 as double) / cast(competitor_full_price as double)", 1)} as markdown_pct
from pricing where competitor_markdown > 0 and competitor_full_price > 0 and scraper not in {R5} order by markdown_pct desc, {", ".join(f"{c} nulls first" for c in _TOP.split(", "))} limit 100)""",
)

# shelf
_WIN = "(select canal, marca, count(*) as wins from (select *, row_number() over (partition by canal, search_term order by nike_visibility desc, marca) as rn from shelf where nike_visibility is not null) where rn = 1 group by canal, marca)"
_TOTALS = "(select canal, count(distinct search_term) as total from shelf group by canal)"
_SHARE = f"(select canal, marca, wins, floor(wins / coalesce(nullif(total, 0), 1) * 1000 + 0.5) / 10 as pct from {_WIN} left join {_TOTALS} using (canal))"
_add("Q17_winners", shelf, shelves.winners, f"select * from {_WIN}")
_add("Q18_term_totals", shelf, shelves.term_totals, f"select * from {_TOTALS}")
_add("Q19_shelf_shares", shelf, shelves.shelf_shares, f"select * from {_SHARE}")
for _key, _brand in zip(("Q20_visibility_own", "Q21_visibility_rival", "Q22_visibility_second"), NAMES.shelf, strict=True):
    _mean = "cast(cast(cast(sum(cast(nike_visibility as decimal(28,10))) as double) / nullif(count(*), 0) as decimal(28,10)) as double) as avg_visibility"
    _counted = _brand == NAMES.shelf[0]
    _add(_key, shelf, lambda s, b=_brand, c=_counted: shelves.brand_visibility(s, b, c), f"select {_mean}{', count(*) as n' if _counted else ''} from shelf where marca = '{_brand}' and nike_visibility is not null")
_add("Q23_searches", shelf, shelves.searches, "select canal, search_term, marca, nike_visibility from shelf where nike_visibility is not null")
_add("Q23_searches_of_channel", shelf, lambda s: shelves.searches(s, "click"), "select canal, search_term, marca, nike_visibility from shelf where nike_visibility is not null and canal = 'click'")
_SEEN = "(select canal, search_term, " + ", ".join(f"min(case when lower(marca) = '{b}' then nike_visibility end) as {b}" for b in ("nike", "adidas", "puma")) + " from shelf where nike_visibility is not null group by canal, search_term)"
_BEST = "greatest(coalesce(nike, -1), coalesce(adidas, -1), coalesce(puma, -1))"
_TABLE = f"(select *, case when coalesce(nike, -1) = {_BEST} then 'Nike' when coalesce(adidas, -1) = {_BEST} then 'Adidas' else 'Puma' end as winner from {_SEEN})"
_add("Q24_search_pivot", shelf, lambda s: shelves.search_table(s).drop("winner"), f"select * from {_SEEN}")
_add("Q25_search_winner", shelf, shelves.search_table, f"select * from {_TABLE}")

# what the dashboard derives
_add("D01_position_shares", pricing, lambda p: show.position_shares(price.summary_kpis(p)), f"select cast(floor(total_beat / t * 100 + 0.5) as bigint) as beat_pct, cast(floor(total_lose / t * 100 + 0.5) as bigint) as lose_pct from (select *, total_beat + total_meet + total_lose as t from ({_KPIS}))")


def _units(x: str, digits: int) -> str:
    """Units of 10^-digits of a positive double, on its exact binary value: the fraction times 2^70 is whole."""
    part, one = f"cast(({x} - floor({x})) * 1180591620717411303424.0::double as hugeint)", 10**digits
    return f"cast(cast(floor({x}) as hugeint) * {one} + ({2 * one} * {part} + 1180591620717411303424::hugeint) // 2361183241434822606848::hugeint as bigint)"


_SLICES = f"(unpivot (select {_positions(True)} from pricing where marca = '{RIVAL}') on beat, meet, lose, nd into name name value value)"
_OF_ALL = "value::double / sum(value) over () * 100"
_add("D02_position_slices", pricing, lambda p: show.position_slices(price.brand_positions(p, RIVAL)), f"select name, value, {_units('x', 1)} / 10 as pct_tooltip, cast({_units('x', 0)} as double) as pct_legend from (select *, {_OF_ALL} as x from {_SLICES}) where value > 0")
_add("D02_slices_of_all_brands", pricing, lambda p: _slices_by_brand(p), f"select marca, name, value, {_units('x', 1)} / 10 as pct_tooltip, cast({_units('x', 0)} as double) as pct_legend from (select *, value::double / sum(value) over (partition by marca, division) * 100 as x, division from (unpivot (select marca, division_competitor as division, {_positions(True)} from pricing group by all) on beat, meet, lose, nd into name name value value)) where value > 0".replace("select marca, name", "select marca, division, name"))
_LISTED = f"({_franchises(f'marca in {RIVALS}')})"
_add("D03_franchises_by_brand", pricing, lambda p: show.franchises_by_brand(price.franchises(p)), f"select marca, count(*) as franchises from {_LISTED} group by marca")
_BARS = f"""(select *, row_number() over (partition by marca order by "count" desc, franchise, division nulls first) as r from {_LISTED} qualify r <= 15)"""
_BEATEN = "cast(case when beat + meet + lose > 0 then floor(beat / (beat + meet + lose) * 100 + 0.5) else 0 end as bigint) as beat_pct"
_add("D04_franchise_bars", pricing, lambda p: show.franchise_bars(price.franchises(p)), f'select marca, franchise, division, "count", {_BEATEN}, max(r) over (partition by marca) - r + 1 as place from {_BARS}')
_add("D05_franchise_beaten", pricing, lambda p: show.franchise_bars(price.franchises(p)).select("marca", "franchise", "division", "beat_pct"), f"select marca, franchise, division, {_BEATEN} from {_BARS}")
_add("D06_retailers_monitored", shelf, lambda s: show.retailers_monitored(shelves.winners(s)), f"select count(distinct canal) as retailers from {_WIN}")
_add("D07_shelf_bars", shelf, lambda s: show.shelf_bars(shelves.shelf_shares(s)), f"select canal, marca, pct, row_number() over (partition by canal order by pct desc, marca) as place, case when pct >= 12 then concat(cast(pct as string), '%') end as label from {_SHARE}")
_add("D08_search_detail", shelf, lambda s: show.search_detail(shelves.search_table(s)), f"select *, (select count(*) from {_TABLE}) as total from {_TABLE} order by canal, search_term limit 80")
_PCT = "(abs(cast({0} as double) * 100))"
_PCT_TEXT = "concat(case when {0} > 0 then '+' when {0} < 0 then '-' else '' end, cast(" + _units(_PCT, 1) + " // 10 as varchar), '.', cast(" + _units(_PCT, 1) + " % 10 as varchar), '%')"
_add(
    "D09_product_lines", pricing, lambda p: show.product_lines(price.product_page(p)),
    f"""select id, coalesce(nullif(style_color, ''), productcode_competitor) as code, coalesce(nullif(product_name_competitor, ''), marketing_name) as name,
case when gap_final_price_pct is null then '—' else {_PCT_TEXT.format('cast(gap_final_price_pct as decimal(10,6))')} end as gap, case when competitor_markdown > 0 then competitor_full_price end as struck_price, competitor_final_price as price from ({_page('true')})""",
)
_add("D10_page_window", pricing, lambda p: _windows(p), "select brand, page, greatest(1, least(page - 2, pages - 4)) + k as button from (select *, unnest(range(1, pages + 1)) as page from (select marca as brand, cast(ceil(count(*) / 50) as bigint) as pages from pricing where marca is not null group by 1)), (select unnest(range(0, 5)) as k) where greatest(1, least(page - 2, pages - 4)) + k <= pages")
_add("D11_visibility_pct", shelf, lambda s: s.select("id", show.visibility_pct(F.col("nike_visibility")).alias("text")), "select id, case when nike_visibility is null then '—' else concat(cast(cast(floor(nike_visibility * 100 + 0.5) as bigint) as string), '%') end as text from shelf")


def _slices_by_brand(p: DataFrame) -> DataFrame:
    """The donut of each brand and division: many shares, ties among them."""
    keys = ["marca", F.col("division_competitor").alias("division")]
    return show.position_slices(p.groupBy(*keys).agg(*position_counts(F.col("bml_final_price"), null_as_nd=True)), ["marca", "division"])


def _windows(p: DataFrame) -> DataFrame:
    pages = p.where("marca is not null").groupBy(F.col("marca").alias("brand")).agg(F.ceil(F.count("*") / 50).cast("long").alias("pages"))
    return show.page_windows(pages)


# how values are written
def _texts(column: str, **made: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda p: p.select("id", *[f(F.col(column)).alias(n) for n, f in made.items()])


_WHOLE = "replace(format('{{:,}}', cast(round(abs({0}), 0) as bigint)), ',', '.')"
_PRICE_TEXT = "case when {0} is null then 'N/D' else concat(case when round({0}, 0) < 0 then '-' else '' end, '$\u00a0', " + _WHOLE + ") end"
_money = "competitor_final_price"
_add("U01_format_price", pricing, _texts(_money, text=show.format_price), f"select id, {_PRICE_TEXT.format('competitor_final_price')} as text from pricing")
_add("U02_format_pct", pricing, _texts("gap_final_price_pct", text=show.format_pct), f"select id, case when gap_final_price_pct is null then 'N/D' else {_PCT_TEXT.format('gap_final_price_pct')} end as text from pricing")
_add("U03_format_number", pricing, _texts(_money, text=show.grouped_number), f"select id, case when competitor_final_price is null then '0' else {_WHOLE.format('competitor_final_price')} end as text from pricing")


def _case(field: int) -> str:
    rows = "".join(f" when '{r[0]}' then '{r[field]}'" for r in show.POSITION_LOOKS[:-1])
    return f"case upper(bml_final_price){rows} else '{show.POSITION_LOOKS[-1][field]}' end"


_label = "bml_final_price"
_add("U04_position_looks", pricing, _texts(_label, colour=show.position_colour, badge=show.position_badge), f"select id, {_case(1)} as colour, {_case(2)} as badge from pricing")
_add("U05_position_name", pricing, _texts(_label, text=show.position_name), f"select id, {_case(3)} as text from pricing")
_DIVISION = "case when division_competitor is null or division_competitor = '' then 'N/D' when contains(upper(division_competitor), 'FOOT') or upper(division_competitor) = 'FW' then 'Footwear' when contains(upper(division_competitor), 'APP') or upper(division_competitor) = 'AP' then 'Apparel' when contains(upper(division_competitor), 'EQUIP') or upper(division_competitor) = 'EQ' then 'Equipment' else division_competitor end"
_add("U06_normal_division", pricing, _texts("division_competitor", text=show.normal_division), f"select id, {_DIVISION} as text from pricing")
_add("U07_truncated", pricing, _texts("marketing_name", text=lambda c: show.truncated(c, 9)), "select id, case when length(marketing_name) > 9 then concat(substring(marketing_name, 1, 8), '…') else marketing_name end as text from pricing")


# ingest: the price table through CSV text and back
def _through_csv(p: DataFrame) -> DataFrame:
    from gondola.schema import LOADED
    from gondola.sources.ingest import clean, read_csv
    from gondola.sources.paths import new_path

    spark, path = p.sparkSession, new_path(p.sparkSession, "csv")
    cells = [F.col(target).cast("string").alias(source) for source, target, _ in LOADED if target in p.columns]
    p.select(*cells).write.csv(path, header=True, quote='"', escape='"', quoteAll=False)
    return views.bml_summary(clean(read_csv(spark, path))[0])


_add("A01_csv_round_trip", pricing, _through_csv, ORACLES["V01_bml_summary"].removeprefix(PRICING_SQL))


# odd cells through the cleaning: what is read of them, row by row
_ODD_PRICE = ("'nan'", "' 12.345 '", "'1_000.5'", "'abc'", "'1e3'", "'-7'", "cast(competitor_final_price as string)")
_ODD_PRICE_READ = ("null", "12.35", "1000.5", "null", "1000", "-7", "cast(competitor_final_price as double)")
_ODD_DATE = ("'2024-3-7'", "'2024-13-01'", "'#N/A'", "'2024-02-29'", "'2023-02-29'")
_ODD_DATE_READ = ("'2024-03-07'", "null", "null", "'2024-02-29'", "null")
_ODD_SIZE = ("'3.5'", "'2.4999'", "'x'", "' 7 '")
_ODD_SIZE_READ = ("4", "2", "null", "7")
_ODD_TEXT = ("'  padded  '", "'None'", "'none'", "'N/A'", "'a \"quoted\" cell'")
_ODD_TEXT_READ = ("'padded'", "null", "'none'", "null", "'a \"quoted\" cell'")


def _by_id(values: tuple[str, ...]) -> str:
    return "case " + " ".join(f"when id % {len(values)} = {n} then {v}" for n, v in enumerate(values)) + " end"


def _odd_cells(p: DataFrame, *more: Column) -> DataFrame:
    cells = {"StyleColor": "cast(id as string)", "Competitor_Final_Price": _by_id(_ODD_PRICE), "Fecha_Corrida": _by_id(_ODD_DATE), "Size_Available_Competitor": _by_id(_ODD_SIZE), "Marca": _by_id(_ODD_TEXT), "Unknown": "'ignored'"}
    return p.select(*[F.expr(x).alias(c) for c, x in cells.items()], *more)


def _read_back(p: DataFrame) -> DataFrame:
    from gondola.sources.ingest import clean

    return clean(_odd_cells(p))[0].select("style_color", "competitor_final_price", "fecha_corrida", "size_available_competitor", "marca", "scraper")


_add(
    "A02_A06_odd_cells", pricing, _read_back,
    f"select cast(id as string) as style_color, cast({_by_id(_ODD_PRICE_READ)} as double) as competitor_final_price, {_by_id(_ODD_DATE_READ)} as fecha_corrida, cast({_by_id(_ODD_SIZE_READ)} as int) as size_available_competitor, {_by_id(_ODD_TEXT_READ)} as marca, cast(null as string) as scraper from pricing",
)


def _odd_csv(p: DataFrame) -> str:
    """A CSV file some of whose rows overflow a column."""
    from gondola.sources.paths import new_path

    path = new_path(p.sparkSession, "csv")
    over = F.when(F.col("id") % 50 == 3, "99999999999").alias("Gap_Final_Price_Pct")
    _odd_cells(p, over).write.csv(path, header=True, quote='"', escape='"')
    return path


def _two_loads(spark: SparkSession, path: str, truncate: bool) -> tuple[str, list]:
    """Two loads of the same file: the table's path and what the loads report."""
    from gondola.sources.ingest import load
    from gondola.sources.paths import new_path

    table = new_path(spark, "prices")
    return table, [load(spark, path, table, truncate=truncate) for _ in range(2)]


def _loaded(p: DataFrame, truncate: bool) -> DataFrame:
    from gondola.sources.ingest import quarantined, read_prices, run_log

    spark = p.sparkSession
    table = _two_loads(spark, _odd_csv(p), truncate)[0]
    counts = lambda df, what, key: df.agg(F.count("*").alias("stored"), F.countDistinct(key).alias("distinct_stored")).select(F.lit(what).alias("what"), "stored", "distinct_stored")
    log = run_log(spark, table).groupBy(F.concat(F.lit("runs "), "status").alias("what")).agg(F.sum("rows_inserted").alias("stored"), F.count("*").alias("distinct_stored"))
    return counts(read_prices(spark, table), "table", "style_color").unionByName(counts(quarantined(spark, table), "quarantine", "StyleColor")).unionByName(log)


def _serial_ids(p: DataFrame) -> DataFrame:
    """Ids after two loads, and after a truncating one."""
    from gondola.sources.ingest import read_prices

    path, out = _odd_csv(p), []  # all four loads are of one file
    for what, truncate in (("two loads", False), ("truncated", True)):
        rows = read_prices(p.sparkSession, _two_loads(p.sparkSession, path, truncate)[0])
        out.append(rows.agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.count("created_at").alias("dated")).withColumn("what", F.lit(what)))
    return out[0].unionByName(out[1])


def _reports(p: DataFrame) -> DataFrame:
    """What the loads say of themselves; the last report again for a run that is done."""
    table, reports = _two_loads(p.sparkSession, _odd_csv(p), False)
    from gondola.sources.ingest import load

    reports.append(load(p.sparkSession, "not read", table, run_id=reports[-1].run_id))
    rows = [(n, r.status, r.total, r.inserted, r.errors, r.seconds > 0) for n, r in enumerate(reports)]
    return p.sparkSession.createDataFrame(rows, "load long, status string, total long, inserted long, errors long, timed boolean")


def _load_sql(times: int) -> str:
    good, bad = _if("id % 50 <> 3"), _if("id % 50 = 3")
    ids = lambda where: f"count(distinct case when {where} then id end)"
    return f"""select 'table' as what, {times} * {good} as stored, {ids("id % 50 <> 3")} as distinct_stored from pricing union all
select 'quarantine', 2 * {bad}, {ids("id % 50 = 3")} from pricing union all select 'runs partial', 2 * {good}, 2 from pricing"""


_add("A07_A09_A10_append", pricing, lambda p: _loaded(p, False), _load_sql(2))
_add("A08_truncate_first", pricing, lambda p: _loaded(p, True), _load_sql(1))
_GOOD = f"(select {_if('id % 50 <> 3')} as good, {_if('id % 50 = 3')} as bad from pricing)"
_add("A11_load_reports", pricing, _reports, f"select load, 'partial' as status, good + bad as total, good as inserted, bad as errors, true as timed from {_GOOD}, (select unnest(range(3)) as load)")
_add("A12_serial_ids", pricing, _serial_ids, f"select what, 1 as first, n * good as last, n * good as rows, n * good as ids, n * good as dated from {_GOOD}, (values ('two loads', 2), ('truncated', 1)) x(what, n)")


# bodies, read back from their JSON
def _summary_back(p: DataFrame) -> DataFrame:
    kinds = responses.summary_parts(p).schema
    x = responses.pricing_summary(p).select(F.from_json("body", kinds).alias("x")).select("x.*")
    return x.select(F.col("kpis.total_beat").alias("total_beat"), F.col("kpis.adidas_avg_price").alias("adidas_avg_price"), F.col("bml_puma.lose").alias("puma_lose"), F.posexplode("top_adidas").alias("place", "line")).select("total_beat", "adidas_avg_price", "puma_lose", F.col("place").cast("long").alias("place"), "line.*")


_add(
    "A14_summary_body", pricing, _summary_back,
    f"""select total_beat, adidas_avg_price, lose as puma_lose, row_number() over (order by "count" desc, franchise) - 1 as place, franchise, "count", avg_price, avg_gap_pct
from ({ORACLES['Q04_top_rival'].removeprefix(PRICING_SQL)}), ({_KPIS}), (select lose from ({ORACLES['Q03_bml_second'].removeprefix(PRICING_SQL)}))""",
)
_PAGE2 = ProductParams(page=2, page_size=20, marca=RIVAL)


def _products_back(p: DataFrame) -> DataFrame:
    x = responses.products(p, _PAGE2).select(F.from_json("body", "products array<struct<id:long,competitor_final_price:double>>, total long, page int, pageSize int, totalPages long").alias("x")).select("x.*")
    return x.select("total", "page", "pageSize", "totalPages", F.posexplode("products").alias("place", "line")).select("total", "page", "pageSize", "totalPages", F.col("place").cast("long").alias("place"), "line.*")


_add(
    "A14_products_body", pricing, _products_back,
    f"""select (select count(*) from pricing where marca = '{RIVAL}') as total, 2 as page, 20 as "pageSize", cast(ceil((select count(*) from pricing where marca = '{RIVAL}') / 20) as bigint) as "totalPages", row_number() over (order by {_ORDER}) - 1 as place, id, cast(competitor_final_price as double) as competitor_final_price
from (select * from pricing where marca = '{RIVAL}' order by {_ORDER} limit 20 offset 20)""",
)


def _shelf_back(s: DataFrame) -> DataFrame:
    x = responses.shelf_summary(s).select(F.from_json("body", "byCanal map<string,array<struct<marca:string,wins:long,pct:double>>>, global struct<n:long>, totalByCanal map<string,long>").alias("x")).select("x.*")
    won = x.select(F.col("global.n").alias("n"), "totalByCanal", F.explode("byCanal").alias("canal", "won"))
    return won.select("n", F.col("totalByCanal")[F.col("canal")].alias("total"), "canal", F.explode("won").alias("line")).select("n", "total", "canal", "line.*")


_add("A14_shelf_body", shelf, _shelf_back, f"select (select count(*) from shelf where marca = '{NAMES.shelf[0]}' and nike_visibility is not null) as n, total, canal, marca, wins, pct from {_SHARE} join {_TOTALS} using (canal)")
_add("A14_search_lines", shelf, lambda s: responses.search_lines(s).select(F.from_json("body", "canal string, search_term string, winner string").alias("x")).select("x.*"), f"select canal, search_term, winner from {_TABLE}")


def _list_back(answer: DataFrame, name: str, fields: str) -> DataFrame:
    """A body's list, with the place of each line."""
    x = answer.select(F.from_json("body", f"`{name}` array<struct<{fields}>>").alias("x"))
    return x.select(F.posexplode(f"x.{name}").alias("place", "line")).select(F.col("place").cast("long").alias("place"), "line.*")


def _bare(key: str) -> str:
    sql = ORACLES[key]
    return sql.removeprefix(PRICING_SQL).removeprefix(SHELF_SQL)


def _placed(key: str, order: str, columns: str = "*") -> str:
    return f"select row_number() over (order by {order}) - 1 as place, {columns} from ({_bare(key)})"


_LISTS = {
    "franchises": (responses.franchises, "franchises", "franchise:string,marca:string,division:string,count:long,avg_price:double,nd:long,avg_sizes:double", "Q06_franchises", '"count" desc, franchise, marca, division nulls first', 'franchise, marca, division, "count", avg_price, nd, avg_sizes'),
    "silhouettes": (responses.silhouettes, "siluetas", "silueta:string,marca:string,count:long,avg_price:double,beat:long,lose:long", "Q07_silhouettes", '"count" desc, silueta, marca', "*"),
    "pvp_retailers": (responses.pvp_compliance, "retailers", "scraper:string,total:long,compliant:long,avg_pvp:double,compliance_pct:long", "Q11_pvp_by_retailer", "total desc, scraper", "scraper, total, compliant, avg_pvp, compliance_pct"),
    "pvp_violations": (responses.pvp_compliance, "violations", "scraper:string,style_color:string,marketing_name:string,franchise_scrapper:string,competitor_final_price:double,precio_sugerido:double,diff_pct:double,link_pdp_competitor:string", "Q13_pvp_violations", "diff_pct nulls last, " + ", ".join(f"{c} nulls first" for c in _VIOLATION.split(", ")), "*"),
    "markdown_retailers": (responses.markdown_analysis, "by_retailer", "scraper:string,marca:string,total:long,in_promo:long,promo_pct:double,avg_markdown_abs:double,avg_markdown_pct:double", "Q14_markdown_by_retailer", "promo_pct desc, scraper, marca nulls first", "*"),
    "markdown_brands": (responses.markdown_analysis, "by_marca", "marca:string,total:long,in_promo:long,promo_pct:double,avg_markdown_pct:double", "Q15_markdown_by_brand", "promo_pct desc, marca nulls first", "*"),
    "markdown_top": (responses.markdown_analysis, "top_markdowns", "scraper:string,marca:string,style_color:string,competitor_final_price:double,markdown_pct:double", "Q16_top_markdowns", "markdown_pct desc, " + ", ".join(f"{c} nulls first" for c in _TOP.split(", ")), "scraper, marca, style_color, competitor_final_price, markdown_pct"),
}
for _name, (_answer, _list, _fields, _key, _order, _columns) in _LISTS.items():
    _add(f"A14_{_name}_body", pricing, lambda p, f=_answer, n=_list, x=_fields: _list_back(f(p), n, x), _placed(_key, _order, _columns))
_add("A14_searches_body", shelf, lambda s: _list_back(responses.shelf_searches(s), "rows", "canal:string,search_term:string,nike:double,adidas:double,puma:double,winner:string"), _placed("Q25_search_winner", "canal, search_term"))
_add(
    "A14_shelf_means", shelf, lambda s: responses.shelf_parts(s).select("global.*"),
    "select " + ", ".join(f"(select avg_visibility from ({_bare(k)})) as {b}" for k, b in (("Q20_visibility_own", "nike"), ("Q21_visibility_rival", "adidas"), ("Q22_visibility_second", "puma"))) + f", (select n from ({_bare('Q20_visibility_own')})) as n",
)


def _after_loads(rows: DataFrame, table: str, of: State) -> tuple[DataFrame, DataFrame]:
    """The rows and their state after five loads: one that a truncate hides, two refreshed,
    one folded with them, one as it is read."""
    from gondola.sources.ingest import append, read_prices, read_shelf
    from gondola.sources.paths import new_path
    from gondola.sources.states import Kept
    from gondola.sources.versions import VersionedTable

    path = new_path(rows.sparkSession, table)
    state = Kept(VersionedTable(rows.sparkSession, path), of)
    part = lambda n: rows.where(F.pmod("id", F.lit(4)) == n)
    for n, then in ((3, state.refresh), (0, state.refresh), (1, state.refresh), (2, state.compact)):
        append(part(n), path, table, truncate=n == 0)
        then()
    append(part(3), path, table)
    return (read_prices if table == "pricing" else read_shelf)(rows.sparkSession, path), state.rows()


def _searched(p: DataFrame, params: ProductParams) -> DataFrame:
    """Products found by trigram postings; ids are those of the loads and left out."""
    rows, rest = search.narrowed(*_after_loads(p, "pricing", search.SEARCH_STATE), params)
    return rows.where(rest.predicate()).groupBy("style_color", "product_name_competitor", "franchise_competitor").agg(F.count("*").alias("n"))


for _key, _view in (("V01_bml_summary", kept.bml_summary), ("V02_franchise_summary", kept.franchise_summary), ("V03_shelf_share", kept.shelf_share)):
    _add(f"{_key}_kept", pricing, lambda p, v=_view: v(_after_loads(p, "pricing", kept.PRICE_STATE)[1]), _bare(_key))
for _key, _view in (("Q17_winners", kept.winners), ("Q18_term_totals", kept.term_totals), ("Q19_shelf_shares", kept.shelf_shares), ("Q25_search_winner", kept.search_table)):
    _add(f"{_key}_kept", shelf, lambda s, v=_view: v(_after_loads(s, "shelf", kept.SHELF_STATE)[1]), _bare(_key))
for _name in ("franchise_ilike", "search"):
    _add(f"F05_F06_{_name}_postings", pricing, lambda p, x=_PRODUCT_CASES[_name][0]: _searched(p, x), f"select style_color, product_name_competitor, franchise_competitor, count(*) as n from pricing where {_PRODUCT_CASES[_name][1]} group by all")


def _clustered(p: DataFrame) -> DataFrame:
    """The rows after three loads: one that a truncate hides, one copied in the questions'
    order, one read from its own files."""
    from gondola.sources.clustered import PRICES, Clustered
    from gondola.sources.ingest import append
    from gondola.sources.paths import new_path
    from gondola.sources.versions import VersionedTable

    path = new_path(p.sparkSession, "pricing")
    copies = Clustered(VersionedTable(p.sparkSession, path), PRICES)
    part = lambda n: p.where(F.pmod("id", F.lit(3)) == n if n < 2 else F.pmod("id", F.lit(3)) > 0)
    append(part(1), path)
    append(part(0), path, truncate=True)
    copies.refresh()
    append(part(2), path)
    return copies.rows()


for _key in ("Q06_franchises_d2c", "Q07_silhouettes_own", "Q11_pvp_by_retailer", "Q13_pvp_violations", "Q14_markdown_by_retailer", "Q15_markdown_by_brand", "Q16_top_markdowns"):
    _add(f"{_key}_clustered", pricing, lambda p, q=_RUNS[_key]: q(_clustered(p)), _bare(_key))
