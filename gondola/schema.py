"""Tables, columns and constant sets of the shelf and price data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# CSV column, table column, type; in the order of the table.
_PRICING = """
Fecha_Corrida fecha_corrida date
Scraper scraper text
Canal canal text
Marca marca text
Season season text
StyleColor style_color text
Product_Code_Competitor product_code_competitor text
Marketing_Name marketing_name text
Division division text
Category category text
Franchise_Scrapper franchise_scrapper text
Gender gender text
GAMA_BOTIN gama_botin text
PLATO plato text
NDDC nddc text
ProductCode_Competitor productcode_competitor text
Product_Name_Competitor product_name_competitor text
Category_Competitor category_competitor text
Division_Competitor division_competitor text
Franchise_Competitor franchise_competitor text
Gender_Competitor gender_competitor text
Size_Available_Competitor size_available_competitor int
Size_Available_Nike size_available_nike int
Link_PDP_Competitor link_pdp_competitor text
Competitor_Full_Price competitor_full_price money
Competitor_Markdown competitor_markdown money
Competitor_Final_Price competitor_final_price money
Competitor_Shipping competitor_shipping money
Competitor_Price_Shipping competitor_price_shipping money
Cuotas_Competitor cuotas_competitor text
Nike_Full_Price nike_full_price money
Nike_Markdown nike_markdown money
Nike_Final_Price nike_final_price money
Nike_Shipping nike_shipping money
Nike_Price_Shipping nike_price_shipping money
Cuotas_Nike cuotas_nike text
Gap_Final_Price_Pct gap_final_price_pct share
Gap_Full_Price_Pct gap_full_price_pct share
Gap_Shipping_Pct gap_shipping_pct share
BML_Final_Price bml_final_price text
BML_Full_Price bml_full_price text
BML_with_Shipping bml_with_shipping text
BML_Cuotas bml_cuotas text
FX_ARS_USD fx_ars_usd dollars
Competitor_Price_USD competitor_price_usd dollars
Competitor_Price_USD_IVA competitor_price_usd_iva dollars
Competitor_Price_USD_IVA_BF competitor_price_usd_iva_bf dollars
Gap_Full_Price_USD gap_full_price_usd dollars
Gap_Full_Price_USD_IVA gap_full_price_usd_iva dollars
Gap_Full_Price_USD_IVA_BF gap_full_price_usd_iva_bf dollars
Gap_Final_Price_USD gap_final_price_usd dollars
Gap_Markdown_Price_USD gap_markdown_price_usd dollars
BML_vs_NikeAR bml_vs_nikear text
BML_vs_NikeAR_IVA bml_vs_nikear_iva text
BML_vs_NikeAR_IVA_BF bml_vs_nikear_iva_bf text
__source_file__ source_file text
Text_Sizes_Nike text_sizes_nike text
Text_Sizes_Competitor text_sizes_competitor text
PDP_Nike pdp_nike text
Rango_Precio rango_precio text
Precio_Sugerido precio_sugerido money
Price_Index price_index share
Silueta silueta text
"""

_TYPES: dict[str, T.DataType] = {
    "date": T.DateType(),
    "text": T.StringType(),
    "int": T.IntegerType(),
    "money": T.DecimalType(12, 2),
    "share": T.DecimalType(10, 6),
    "dollars": T.DecimalType(12, 4),
}

#: (CSV column, table column, type) of what the loader fills.
LOADED = [(source, target, _TYPES[kind]) for source, target, kind in map(str.split, _PRICING.strip().splitlines())]

PRICING = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, kind) for _, c, kind in LOADED], T.StructField("created_at", T.TimestampType())])

SHELF = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("fecha_corrida", T.DateType()),
        T.StructField("scraper", T.StringType()),
        T.StructField("canal", T.StringType(), False),
        T.StructField("marca", T.StringType(), False),
        T.StructField("season", T.StringType()),
        T.StructField("search_term", T.StringType(), False),
        T.StructField("nike_visibility", T.DoubleType()),
        *[T.StructField(c, T.StringType()) for c in ("type", "category", "level_1", "level_2", "level_3", "division")],
        T.StructField("created_at", T.TimestampType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("scraper_name", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("rows_inserted", T.IntegerType()),
        T.StructField("rows_updated", T.IntegerType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
    ]
)

ALERTS = T.StructType(
    [
        *[T.StructField(c, T.StringType(), False) for c in ("id", "scraper_name", "alert_type", "severity", "message")],
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
        T.StructField("sent_email", T.BooleanType()),
        T.StructField("sent_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


@dataclass(frozen=True)
class Names:
    """Brands and feeds that the queries know by name (case matters)."""

    own: str = "NIKE"
    rival: str = "ADIDAS"
    second: str = "Puma"
    #: the same brands as the shelf table writes them
    shelf: tuple[str, str, str] = ("Nike", "Adidas", "Puma")
    #: feeds that are not resellers
    not_resellers: tuple[str, ...] = ("ADIDAS_7", "Puma_AR", "nike_ar_general", "nike_co_general", "nike_us_general", "URU", "USA")
    #: own and foreign feeds only
    own_feeds: tuple[str, ...] = ("nike_ar_general", "nike_co_general", "nike_us_general", "URU", "USA")
    #: direct-to-consumer feeds, as the franchise and the product listing see them
    direct_franchises: tuple[str, ...] = ("ADIDAS_7", "Puma_AR")
    direct_products: tuple[str, ...] = ("ADIDAS_7", "Puma_AR", "nike_ar_general")
    combined_feed: str = "%AdidasPuma%"

    @property
    def brands(self) -> tuple[str, ...]:
        return (self.rival, self.second, self.own)

    @property
    def rivals(self) -> tuple[str, ...]:
        return (self.rival, self.second)


NAMES = Names()
#: Price position labels; from the competitor's side, BEAT is the cheaper one.
POSITIONS = ("BEAT", "MEET", "LOSE")
