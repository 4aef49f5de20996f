"""Extension: the price position summary kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gondola.operators.views import bml_summary
from gondola.schema import LOADED
from gondola.sources.ingest import clean


def price_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New CSV files of a folder, cleaned; too large numbers are left out."""
    schema = T.StructType([T.StructField(source, T.StringType()) for source, _, _ in LOADED])
    raw = spark.readStream.schema(schema).csv(folder, header=True, multiLine=True, quote='"', escape='"')
    return clean(raw)[0]


def live_summary(prices: DataFrame) -> DataFrame:
    """For output mode "complete" or "update": state is one row for each feed and brand."""
    return bml_summary(prices)
