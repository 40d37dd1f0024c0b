"""Running sums over arrays in rows, for places in a text from the lengths of its pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers summed as one block. An array grows by copying, so one scan over n numbers would copy n * n / 2 of them.
BLOCK = 128


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(xs: Column, add) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    step = lambda acc, x: let(add(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))
    return F.aggregate(xs, start, step)["out"]


def _running(xs: Column, add) -> Column:
    """What ``add`` makes of the numbers up to and with each: inside blocks, then over them. It starts from 0."""

    def of_blocks(xs: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))

        def shifted(inner: Column) -> Column:
            ends = _scan(F.transform(inner, lambda b: F.element_at(b, -1)), add)
            return F.flatten(F.transform(inner, lambda b, k: let(F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1)).cast("long"), lambda base: F.transform(b, lambda x: add(x, base)))))

        return let(F.transform(cuts, lambda k: _scan(F.slice(xs, k, F.lit(BLOCK)), add)), shifted)

    return let(xs, lambda xs: F.when(F.size(xs) <= BLOCK, _scan(xs, add)).otherwise(of_blocks(xs)))


def running_sums(xs: Column) -> Column:
    """The sum up to and with each number."""
    return _running(xs, lambda a, b: a + b)


def running_max(xs: Column) -> Column:
    """The largest number up to and with each, 0 at least."""
    return _running(xs, lambda a, b: F.greatest(a, b))
