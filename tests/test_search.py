"""Search by postings against ilike over all rows."""

import pytest
from pyspark.sql import functions as F

from gondola.operators.filters import ProductParams
from gondola.operators.search import SEARCH_STATE, SEARCHED, containing, demanded, narrowed
from gondola.sources import ingest
from gondola.sources.states import Kept
from gondola.sources.versions import VersionedTable

ROWS = [
    ("Air Max 90", "SC100", "AIR MAX"), ("AIR max 95", "SC%01", "Air Max"), ("100% cotton", "S_C", None), (None, None, None), ("", "ab", "abc"), ("back\\slash", "x", "Ñandú ÑA"), ("İstanbul", "ΣΑΣ", "ΟΔΥΣΣΕΥΣ Σ"),
    ("Air Max 90", "SC100", "AIR MAX"), ("new\nline", "tab\there", "aaaaaa"), ("max air", "maxmax", "ma x"), ("😀😀😀 run", "sc1xx5", "𝔘nicode"),
]
TEXTS = ["air max", "MAX", "sc1", "sc1%5", "00%", "100\\% c", "s\\_c", "a_r", "_", "%", "ab", "abc", "ñandú", "ÑA", "istanbul", "İst", "σας", "ΣΑΣ", "υς σ", "aaaa", "new\nline", "back\\slash", "😀😀😀", "zzz", "air%9_", "ma x", "max\\", "''\"", "air max zzz"]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in SEARCHED))
    table = VersionedTable(spark, str(tmp_path_factory.mktemp("search")))
    state = Kept(table, SEARCH_STATE)
    ingest.append(rows.limit(6), table.path)
    state.refresh()
    ingest.append(rows.offset(4), table.path)
    return ingest.read_prices(spark, table.path).select("id", *SEARCHED).cache(), state.rows().cache()


@pytest.mark.parametrize("text", TEXTS)
def test_same_rows_as_a_scan(loaded, text):
    rows, postings = loaded
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    for params in (ProductParams(search=text), ProductParams(franchise=text)):
        wanted = ids(rows.where(params.predicate()))
        for listed in (1000, 0):
            left, rest = narrowed(rows, postings, params, listed)
            assert ids(left.where(rest.predicate())) == wanted and left.columns == rows.columns


def test_some_texts_match(loaded):
    rows, postings = loaded
    assert containing(rows, postings, SEARCHED, "sc1%5").count() == 1 and containing(rows, postings, SEARCHED, "").count() == rows.count()
    both, rest = narrowed(rows, postings, ProductParams(search="max 9", franchise="air"))
    assert both.where(rest.predicate()).count() == rows.where("product_name_competitor ilike '%max 9%' and franchise_competitor ilike '%air%'").count() > 0


def test_trigrams_of_patterns(spark):
    df = spark.range(1)
    assert demanded(df, "%AbCd%") == ["abc", "bcd"] and demanded(df, "%ab_cd%") == [] and demanded(df, "%a\\%b\\_c%") == ["%b_", "a%b", "b_c"]


def test_postings_are_sorted_and_looked_up(loaded, spark, tmp_path):
    rows = spark.range(20000).select(F.concat(F.lit("name "), F.hex(F.col("id") * 7919)).alias("product_name_competitor"))
    table = VersionedTable(spark, f"{tmp_path}/t")
    ingest.append(rows, table.path)
    state = Kept(table, SEARCH_STATE)
    state.refresh()
    found = state.rows().where("field = 'product_name_competitor' and gram = '1ab'")
    assert "EqualTo(gram,1ab)" in found._jdf.queryExecution().toString()
    ends = state.rows().groupBy(F.col("_metadata.file_path")).agg(F.min("gram").alias("low"), F.max("gram").alias("high")).orderBy("low").collect()
    assert all(a.high <= b.low for a, b in zip(ends, ends[1:], strict=False))
