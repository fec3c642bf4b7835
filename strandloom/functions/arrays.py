"""Column functions over arrays whose work stays near linear in long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries that are summed one by one.
STRIDE = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value found once a row, however often the body or its lambdas read it.

    ``body`` is given the value alone: Spark would fill a second parameter, were it one with a default, with the place in the array.
    """
    return F.transform(F.array(value), lambda x: body(x))[0]


def running_sums(numbers: Column) -> Column:
    """Sums of an integer array up to and with each entry, by strides."""

    def of(x: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(STRIDE))
        part = F.transform(begins, lambda at: F.aggregate(F.slice(x, at + 1, F.lit(STRIDE)), F.lit(0), lambda a, v: a + v))
        base = F.aggregate(part, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        inside = lambda s, i: F.aggregate(F.slice(s["x"], i - i % STRIDE + 1, i % STRIDE + 1), F.lit(0), lambda a, v: a + v)
        return let(F.struct(x.alias("x"), base.alias("base")), lambda s: F.transform(s["x"], lambda _, i: F.get(s["base"], F.floor(i / STRIDE).cast("int")) + inside(s, i)))

    return let(numbers, of)
