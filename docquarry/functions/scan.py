"""Running folds over arrays as expressions, in time linear in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where the optimiser merges projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """[step(first, v0), step(that, v1), ...].

    A fold copies what it carries at each step, so only the states before each
    ``PIECE`` values are carried through; each piece is then gone through alone.
    """
    none = F.filter(F.array(first), lambda _: F.lit(False))

    def pieces(every: Column, starts: Column) -> Column:
        def pass_by(acc: Column, at: Column) -> Column:
            return F.struct(F.aggregate(F.slice(every, at, F.lit(PIECE)), acc["state"], step).alias("state"), F.array_append(acc["before"], acc["state"]).alias("before"))

        def one(a: Column, v: Column) -> Column:
            new = step(a["state"], v)
            return F.struct(new.alias("state"), F.array_append(a["own"], new).alias("own"))

        before = F.aggregate(starts, F.struct(first.alias("state"), none.alias("before")), pass_by, lambda a: a["before"])
        return F.flatten(F.zip_with(starts, before, lambda at, state: F.aggregate(F.slice(every, at, F.lit(PIECE)), F.struct(state.alias("state"), none.alias("own")), one, lambda a: a["own"])))

    def walk(every: Column) -> Column:
        return F.when(F.size(every) > 0, let(F.sequence(F.lit(1), F.size(every), F.lit(PIECE)), lambda starts: pieces(every, starts))).otherwise(none)

    return let(values, walk)


def running_sum(values: Column) -> Column:
    """Sums up to and with each value, as longs."""
    return running(values, F.lit(0).cast("long"), lambda total, v: total + v)
