"""Column expressions whose results must not depend on the engine.

Averages and ratios go through decimal(28, 10) before they are rounded: half
away from zero on exact digits, whatever order the rows were summed in.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.schema import POSITIONS

EXACT = "decimal(28,10)"


def rounded(value: Column, digits: int) -> Column:
    """A double, rounded half away from zero on its decimal digits."""
    return F.round(value.cast(EXACT), digits).cast("double")


def avg_rounded(x: Column, digits: int, where: Column | None = None) -> Column:
    """The average of a decimal or integer column; null over no values."""
    x = x if where is None else F.when(where, x)
    return rounded(F.sum(x).cast("double") / F.nullif(F.count(x), F.lit(0)), digits)


def avg_ratio(ratio: Column, digits: int, where: Column | None = None) -> Column:
    """The mean of ratios (not the ratio of sums)."""
    return avg_rounded(ratio.cast(EXACT), digits, where)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def pct(a: Column, b: Column, digits: int = 1) -> Column:
    return rounded(ratio(a * 100, b), digits)


def count_if(where: Column) -> Column:
    """Rows for which the condition is true; never null."""
    return F.count(F.when(where, F.lit(1)))


def position_counts(label: Column, null_as_nd: bool, prefix: str = "") -> list[Column]:
    """beat, meet, lose and nd. ``null_as_nd``: whether rows without a label count
    as nd (the endpoints) or nowhere (the view)."""
    nd = ~label.isin(*POSITIONS)
    if null_as_nd:
        nd = nd | label.isNull()
    return [count_if(label == p).alias(prefix + p.lower()) for p in POSITIONS] + [count_if(nd).alias(f"{prefix}nd")]


def share_pct(a: Column, b: Column) -> Column:
    """a of b in whole percents, divided before it is multiplied, as JavaScript's
    doubles have it: 23 of 40 are 57, not 58."""
    return half_up(a.cast("double") / b * 100).cast("long")


def half_up(x: Column) -> Column:
    """Rounding to whole numbers as JavaScript does: half towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def _thresholds(digits: int) -> list[float]:
    """The smallest doubles from which a fraction is rounded to 1, 2, ... units."""
    units, out = 10**digits, []
    for k in range(units):
        tie = Fraction(2 * k + 1, 2 * units)
        near = float(tie)
        out.append(near if Fraction(near) >= tie else math.nextafter(near, 1.0))
    return out


def fixed_units(x: Column, digits: int = 1) -> Column:
    """|x| in units of 10^-digits, rounded on the exact binary value of the double (not
    on its decimal writing), ties up: 28.75 and 23 / 80 * 100 differ. A fraction of a
    double is exact, and so is its comparison with the least double of each unit."""
    size = F.abs(x.cast("double"))
    whole = F.floor(size)
    part = size - whole
    least = F.array(*[F.lit(x) for x in _thresholds(digits)])
    below = F.greatest(F.floor(part * 10**digits).cast("int") - 1, F.lit(0))  # within one of the answer
    steps = [F.when(part >= F.get(least, below + i), 1).otherwise(0) for i in range(3)]
    return (whole * 10**digits + below + steps[0] + steps[1] + steps[2]).cast("long")


def to_fixed(x: Column, digits: int = 1) -> Column:
    """x with so many digits, as JavaScript's toFixed writes doubles: what rounds to zero
    from below keeps its sign."""
    units, scale = fixed_units(x, digits), 10**digits
    minus = F.when(x < 0, "-").otherwise("")
    whole = F.floor(units / scale).cast("long").cast("string")
    return F.concat(minus, whole, *([F.lit("."), F.lpad((units % scale).cast("string"), digits, "0")] if digits else []))


def like_pattern(text: str) -> str:
    """A user's text inside wildcards. Its own wildcards stay alive; a backslash
    counts only before one of them or another backslash."""
    return "%" + re.sub(r"\\(?![%_\\])(.?)", r"\1", text) + "%"


def present(c: str | Column) -> Column:
    """Neither null nor empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "")
