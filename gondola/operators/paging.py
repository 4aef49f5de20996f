"""Pages far down an order, without sorting what lies before them.

The order's leading keys are whole numbers. A histogram of the first key, a bounded
number of counts, says in which range of it the page begins and ends; a histogram of
that range says it closer, and so on; where very many rows share one value, the next
key takes over. Only the rows of the last ranges are sorted, ``held`` at most in each
unless all keys are equal. Every step is one scan with the range as its filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
HELD = 100_000


@dataclass(frozen=True)
class Key:
    """A leading key of the order: ``units`` is a whole number that grows along it."""

    column: str
    units: Column
    nulls_last: bool


@dataclass(frozen=True)
class Piece:
    """A run of rows of the page: those that ``where`` gives, without the first ``skip``."""

    where: Column
    skip: int
    take: int


def _counts(rows: DataFrame, key: Key, low: int | None = None, width: int = 1) -> dict[int, int]:
    """Rows by bin from ``low``, at most BINS of them."""
    bin_ = F.floor((key.units - F.lit(low)) / F.lit(width)) if width > 1 else key.units - F.lit(low)
    return {r["b"]: r["n"] for r in rows.groupBy(bin_.cast("long").alias("b")).agg(F.count("*").alias("n")).collect()}


def find(rows: DataFrame, keys: list[Key], skip: int, take: int, held: int = HELD, where: Column | None = None, n: int | None = None) -> list[Piece]:
    """The pieces, in order, that hold the rows ``skip`` to ``skip + take`` of the order."""
    where = F.lit(True) if where is None else where
    if not keys or n is not None and n <= held:
        return [Piece(where, skip, take)]
    key, rest = keys[0], keys[1:]
    mine = rows.where(where)
    ends = mine.agg(F.min(key.units).alias("low"), F.max(key.units).alias("high"), F.count("*").alias("n"), F.count(key.units).alias("there")).first()
    if ends["n"] <= held or take <= 0:
        return [Piece(where, skip, take)]
    null = F.col(key.column).isNull()
    parts: list[tuple[Column, int, list[Key] | tuple[int, int]]] = []
    if ends["there"]:
        parts.append((where & ~null, ends["there"], (ends["low"], ends["high"])))
    if ends["n"] > ends["there"]:
        parts.insert(len(parts) if key.nulls_last else 0, (where & null, ends["n"] - ends["there"], rest))
    out: list[Piece] = []
    while parts and take > 0:
        part, count, inner = parts.pop(0)
        if skip >= count:
            skip -= count
            continue
        here = min(take, count - skip)
        if count <= held:
            out.append(Piece(part, skip, here))
        elif isinstance(inner, list):
            out += find(rows, inner, skip, here, held, part, count)
        elif inner[0] == inner[1]:
            out += find(rows, rest, skip, here, held, part, count)
        else:  # closer: the bins that the page touches, small neighbours together
            low, width = inner[0], -(-(inner[1] - inner[0] + 1) // BINS)
            bins, before = [], 0  # (first bin, last bin, rows) of each, and the rows before them
            passed = 0
            for b, c in sorted(_counts(rows.where(part), key, low, width).items()):
                if passed + c <= skip:
                    before = passed + c
                elif passed < skip + here and bins and bins[-1][2] + c <= held:
                    bins[-1] = (bins[-1][0], b, bins[-1][2] + c)
                elif passed < skip + here:
                    bins.append((b, b, c))
                passed += c
            limits = [(low + a * width, low + (b + 1) * width - 1, c) for a, b, c in bins]
            parts[:0] = [(part & (key.units >= F.lit(a)) & (key.units <= F.lit(b)), c, (a, b)) for a, b, c in limits]
            skip -= before
            continue
        take -= here
        skip = 0
    return out


def page(rows: DataFrame, keys: list[Key], order: list[Column], skip: int, take: int, held: int = HELD) -> DataFrame:
    """``rows.orderBy(order).offset(skip).limit(take)``; ``keys`` begin the order. The
    histograms are made at once, the page's rows when they are asked for."""
    out = None
    for p in find(rows, keys, skip, take, held):
        some = rows.where(p.where).orderBy(*order).offset(p.skip).limit(p.take)
        out = some if out is None else out.unionByName(some)
    return rows.limit(0) if out is None else out.orderBy(*order)
