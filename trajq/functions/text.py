"""Number text for reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = float((1 << 27) + 1)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it.

    Unlike a chain of ``withColumn`` steps it stays one level deep when the optimizer moves a
    filter on the result below the projection.
    """
    return F.transform(F.array(x), body)[0]


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of digits, rounded on the exact binary value, ties to even.

    ``format_string`` and ``round`` decide on the shortest decimal text and round ties up, so
    they turn 56.25 into 56.3. The product with the power of ten is split exactly to see on
    which side of a tie the value lies.
    """
    scale = F.lit(float(10**digits))

    def parts(v: Column) -> Column:
        a = F.abs(v)
        c = a * SPLITTER
        hi = c - (c - a)
        y = a * scale
        return F.struct(y.alias("y"), F.floor(y).cast("double").alias("f"), ((hi * scale - y) + (a - hi) * scale).alias("e"), (v < 0).alias("neg"))

    def text(p: Column) -> Column:
        d = p["y"] - p["f"] - 0.5
        odd = F.pmod(p["f"], F.lit(2.0)) == 1
        up = (d > 0) | ((d == 0) & ((p["e"] > 0) | ((p["e"] == 0) & odd)))
        whole = F.when(up, p["f"] + 1).otherwise(p["f"])
        return F.concat(F.when(p["neg"], "-").otherwise(""), F.format_string(f"%.{digits}f", whole / scale))

    return let(let(x.cast("double"), parts), text)
