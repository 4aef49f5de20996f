"""Substring search in text columns by trigram postings, equal to a scan with ``ilike``.

Postings are a state that loads keep up: for each text column the distinct values, each
under all its trigrams (lower case), sorted by trigram so that a lookup reads few row
groups. A search counts the trigrams that its text demands, takes the values under
the rarest of each column, and verifies them by ``ilike``. The rows that have one
of these values are the result: the table's texts are compared for equality only.
Texts without three characters in a row outside of wildcards are searched by scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.exprs import like_pattern
from gondola.operators.filters import ProductParams, all_of, contains
from gondola.schema import PRICING
from gondola.sources.states import State

SEARCHED = ("product_name_competitor", "style_color", "franchise_competitor")
FRANCHISE = ("franchise_competitor",)
#: Up to so many values go to the scan as a list, which it can prune by; more are joined.
LISTED = 1000


def _any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _postings(rows: DataFrame) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in SEARCHED]))
    values = rows.select(cells.alias("cell")).select("cell.*").groupBy("field", "value").agg(F.count("*").alias("n"))
    text = F.lower("value")
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
    return values.where(F.length(text) >= 3).select("field", "value", "n", F.explode(F.array_distinct(grams)).alias("gram"))


SEARCH_STATE = State("postings", PRICING, ("field", "gram", "value"), {"n": "sum"}, lambda: {"n": F.sum("n")}, _postings, ("gram", "field"))


def demanded(df: DataFrame, pattern: str) -> list[str]:
    """The trigrams of all texts that match a LIKE pattern in any case."""
    lower = df.sparkSession.range(1).select(F.lower(F.lit(pattern))).first()[0]  # as ilike does it
    pieces = [""]
    for escaped, plain in re.findall(r"\\(.)|(.)", lower, re.DOTALL):
        if plain in ("%", "_"):
            pieces.append("")
        else:
            pieces[-1] += escaped or plain
    return sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})


def containing(rows: DataFrame, postings: DataFrame, columns: Sequence[str], text: str, listed: int = LISTED) -> DataFrame:
    """The rows with the text, in any case, in one of the columns (of SEARCHED) at least.
    ``postings``: the partial rows of SEARCH_STATE over the same rows, or more."""
    if not text:
        return rows
    pattern = like_pattern(text)
    grams = demanded(rows, pattern)
    if not grams:
        return rows.where(all_of(contains(columns, text)))
    mine = F.col("field").isin(*columns) & F.col("gram").isin(*grams)
    counts = postings.where(mine).groupBy("field", "gram").agg(F.count("*").alias("n")).collect()  # a row for a column and trigram of the text
    by_field = {c: {r["gram"]: r["n"] for r in counts if r["field"] == c} for c in columns}
    rarest = {c: min(found, key=lambda g: (found[g], g)) for c, found in by_field.items() if len(found) == len(grams)}
    if not rarest:
        return rows.where(F.lit(False))
    under = _any_of((F.col("field") == c) & (F.col("gram") == g) for c, g in rarest.items())
    found = postings.where(under & F.col("value").ilike(pattern)).select("field", "value").distinct()
    some = found.limit(listed + 1).collect()
    if len(some) <= listed:
        values = {c: [r["value"] for r in some if r["field"] == c] for c in rarest}
        return rows.where(_any_of(F.col(c).isin(*v) for c, v in values.items() if v))
    marks = []
    for c in rarest:  # each side is distinct, so no row comes twice
        marks.append(f"_in_{c}")
        side = found.where(F.col("field") == c).select(F.col("value").alias(marks[-1]))
        rows = rows.join(side, F.col(c) == F.col(marks[-1]), "left")
    return rows.where(_any_of(F.col(m).isNotNull() for m in marks)).drop(*marks)


def narrowed(rows: DataFrame, postings: DataFrame, params: ProductParams, listed: int = LISTED) -> tuple[DataFrame, ProductParams]:
    """The rows that the texts of ``params`` leave, and the parameters that remain to be
    applied: together what ``params`` asks for."""
    rows = containing(rows, postings, SEARCHED, params.search, listed)
    return containing(rows, postings, FRANCHISE, params.franchise, listed), replace(params, search="", franchise="")
