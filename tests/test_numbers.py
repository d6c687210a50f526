import math
import random

import pytest
from pyspark.sql import functions as F

from citeframe.functions.numbers import half_even


def _values():
    rnd = random.Random(9)
    out = [0.0, -0.0, 0.5, 1.5, 2.5, -2.5, 0.125, 0.375, 2.675, 1.005, 8.33335, 1e15 + 0.5, 2.0**52 - 0.5, 2.0**53 + 2, 1e300, -1e-300, 5e-324, 0.1 + 0.2, 4503599627370495.5, 90071992547409.925]
    for _ in range(20_000):
        out.append(rnd.randrange(-10**7, 10**7) / 10 ** rnd.randrange(8))
        out.append(rnd.randrange(10**9) / 2 ** rnd.randrange(40))  # ties among them
        out.append((rnd.randrange(10**6) * 2 + 1) / 2 / 10 ** rnd.randrange(7))  # what looks like a tie
        x = (rnd.randrange(10**8) + 0.5) / 10 ** rnd.randrange(7)
        out += [math.nextafter(x, math.inf), math.nextafter(x, 0)]
        out.append(rnd.uniform(-1, 1) * 10 ** rnd.uniform(-12, 18))
    return out


@pytest.mark.parametrize("places", [0, 1, 2, 3, 4, 6, 9, 15])
def test_as_python_rounds(spark, places):
    import pandas as pd

    values = _values()
    assert len(values) > 100_000
    rows = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(4)
    wrong = [(r.x, r.y, round(r.x, places)) for r in rows.select("x", half_even(F.col("x"), places).alias("y")).collect() if r.y != round(r.x, places)]
    assert wrong == []


def test_what_is_no_number(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    got = [r.y for r in rows.select(half_even(F.col("x"), 2).alias("y")).collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [math.inf, -math.inf]
    with pytest.raises(ValueError):
        half_even(F.lit(1.0), 16)
