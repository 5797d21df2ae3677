"""Array expressions whose cost does not grow with the square of the array's size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value as a variable of a lambda: it is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks(items: Column) -> Column:
    """items cut into some sqrt(n) runs of some sqrt(n) each; none of an empty array."""

    def cut(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(a), size)
        return F.when(F.size(a) > 0, F.transform(firsts, lambda s: F.slice(a, s, size))).otherwise(F.slice(F.array(a), F.lit(1), F.lit(0)))

    return once(items, cut)


def scan_left(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """What step(state, item) -> (next state, array to add) adds, from left to right. out: the type of an element.

    Adding to an array copies it. So items are taken run by run, and only a run's results and the list of runs are ever
    added to: n * sqrt(n) copies of references, not n * n.
    """
    none = lambda t: F.array().cast(f"array<{t}>")

    def one(a: Column, x: Column) -> Column:
        state, more = step(a["state"], x)
        return F.struct(state.alias("state"), F.concat(a["out"], more).alias("out"))

    def run(a: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(a["state"].alias("state"), none(out).alias("out")), one)
        return once(done, lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    return F.aggregate(blocks(items), F.struct(zero.alias("state"), none(f"array<{out}>").alias("out")), run, lambda a: F.flatten(a["out"]))


def walk_ranges(text: Column, ranges: Column, give: Callable[[Column, Column, Column], Column]) -> Column:
    """struct<out: array<string>, rest>: what give(text before a range, range, text in it) gives, in order, and the text behind the last range.

    ranges: structs with start and end, ascending, apart from each other. A run of ranges first takes the part of the text
    that it covers, so that no step copies the whole rest.
    """
    start = lambda at, rest: F.struct(at.alias("at"), rest.alias("rest"), F.array().cast("array<string>").alias("out"))
    most = F.lit(1 << 30)

    def one(a: Column, f: Column) -> Column:
        gap, size = f["start"] - a["at"], f["end"] - f["start"]
        more = give(F.substring(a["rest"], F.lit(1), gap), f, F.substring(a["rest"], gap + 1, size))
        return F.struct(f["end"].alias("at"), F.substring(a["rest"], gap + size + 1, most).alias("rest"), F.concat(a["out"], more).alias("out"))

    def run(a: Column, part: Column) -> Column:
        covers = F.element_at(part, -1)["end"] - a["at"]
        own = F.aggregate(part, start(a["at"], F.substring(a["rest"], F.lit(1), covers)), one, lambda r: r["out"])
        return F.struct(F.element_at(part, -1)["end"].alias("at"), F.substring(a["rest"], covers + 1, most).alias("rest"), F.concat(a["out"], F.array(own)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<array<string>>").alias("out"))
    return F.aggregate(blocks(ranges), zero, run, lambda a: F.struct(F.flatten(a["out"]).alias("out"), a["rest"].alias("rest")))


def replace_ranges(text: Column, ranges: Column, new: Callable[[Column, Column], Column]) -> Column:
    """text with each range replaced by new(range, what stood there)."""

    def of(found: Column) -> Column:
        done = walk_ranges(text, found, lambda gap, f, value: F.array(gap, new(f, value)))
        return F.when(F.size(found) == 0, text).otherwise(once(done, lambda d: F.array_join(F.concat(d["out"], F.array(d["rest"])), "")))

    return once(ranges, of)
