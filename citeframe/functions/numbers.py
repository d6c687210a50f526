"""Rounding as Python does it: half to even on what a double exactly is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubles from here on are whole numbers, and whole numbers up to the second one are doubles.
_WHOLE, _EXACT = float(1 << 52), 1 << 53
#: Up to here a double tells well which half is nearer.
_FINE = float(1 << 50)


def half_even(x: Column, places: int) -> Column:
    """round(x, places) for 0 to 15 places; null, NaN and infinity stay.

    Spark's round works on the shortest decimal form of a double (2.675 becomes 2.68), Python on its value, which is
    a little less (2.67).  A double is m / 2^k in whole numbers, so x * 10^places = m * 10^places / 2^k is divided
    exactly where the product as a double lies too close to a half to tell.
    """
    if not 0 <= places <= 15:
        raise ValueError("0 to 15 places")
    x = x.cast("double")
    scale = 10.0**places
    y = F.abs(x) * scale
    near = (y >= _FINE) | (F.abs(y - F.floor(y).cast("double") - 0.5) <= y * 4e-16)
    # seldom, so it is kept out of the generated code
    found = F.when(near, _let(F.abs(x), lambda a: _exact(a, places))).otherwise(F.rint(y) / scale)
    return F.when(F.isnan(x) | (F.abs(x) >= _WHOLE), x).otherwise(F.when(x < 0, -found).otherwise(found))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed and written down once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _exact(a: Column, places: int) -> Column:
    """The same of a double from 0 to 2^52, in whole numbers."""
    ten = F.lit(10**places).cast("decimal(16,0)")
    wide = lambda c: c.cast("decimal(38,0)")
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n).cast("decimal(19,0)")

    def told(digits: Column) -> Column:
        return F.when(digits < _EXACT, digits.cast("double") / 10.0**places).otherwise(F.concat(digits.cast("string"), F.lit(f"E-{places}")).cast("double"))

    def divided(x: Column) -> Column:
        up = lambda q: F.when((q["rest"] > x["below"]) | ((q["rest"] == x["below"]) & ((q["down"] + (x["whole"] if places == 0 else F.lit(0))) % 2 == 1)), 1).otherwise(0)
        parts = F.struct(F.call_function("div", x["above"], x["below"]).alias("down"), wide((x["above"] % x["below"]) * F.lit(2).cast("decimal(1,0)")).alias("rest"))
        return _let(parts, lambda q: _let(wide(wide(x["whole"].cast("decimal(19,0)") * ten) + (q["down"] + up(q)).cast("decimal(19,0)")), told))

    def scaled(x: Column) -> Column:
        above = wide((x["part"] * F.pow(F.lit(2.0), x["k"].cast("double"))).cast("bigint").cast("decimal(19,0)") * ten)
        below = wide(power(F.least(x["k"], F.lit(62))) * power(F.greatest(x["k"] - 62, F.lit(0))))
        return _let(F.struct(x["whole"].alias("whole"), above.alias("above"), below.alias("below")), divided)

    # a power more than the mantissa needs, as the logarithm may be off by one
    power_of = lambda p: F.when(p > 0, F.lit(54) - F.floor(F.log2(p)).cast("int")).otherwise(54)
    split = _let(F.floor(a), lambda w: F.struct(w.alias("whole"), (a - w.cast("double")).alias("part")))
    return _let(split, lambda s: _let(F.struct(s["whole"].alias("whole"), s["part"].alias("part"), power_of(s["part"]).alias("k")), scaled))
