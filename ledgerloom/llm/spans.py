"""Places of pattern matches in a text, with what stands around them, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a running value is carried over one by one, before blocks of so many are.
STRIDE = 64
#: Characters before and after a match that are looked at.
NEAR = 64
MATCH = "struct<m:string,start:int,gap:string,after:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: inside a lambda an expression would be computed each time it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element the join of all before it (`zero` for the first). Blocks are joined first, then what is in them, so the work
    stays far from the square of the length."""
    fold = lambda xs: F.aggregate(xs, zero, join)

    def over(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STRIDE).cast("int")), lambda b: F.slice(xs, b * STRIDE + 1, F.lit(STRIDE)))

        def placed_blocks(bs: Column) -> Column:
            return let(F.transform(bs, fold), lambda sums: F.flatten(F.transform(bs, lambda block, k: let(fold(F.slice(sums, F.lit(1), k)), lambda s: F.transform(block, lambda _, i: F.aggregate(F.slice(block, F.lit(1), i), s, join))))))

        return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(let(blocks, placed_blocks))

    return let(values, over)


def placed(text: Column, pattern: str) -> Column:
    """Matches with their places in code points, array of MATCH: splitting at the same pattern gives the gaps between
    matches, and lengths add up to places. gap and after are what stands before and after, up to NEAR characters of the gap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(found.alias("ms"), F.split(text, pattern, -1).alias("gaps"))

    def of(p: Column) -> Column:
        n = F.size(p["ms"])
        lengths = F.zip_with(p["ms"], F.slice(p["gaps"], F.lit(1), n), lambda m, g: F.char_length(m) + F.char_length(g))
        place = lambda at: F.transform(
            p["ms"],
            lambda m, i: let(
                F.get(p["gaps"], i),
                lambda g: F.struct(m.alias("m"), (F.get(at, i) + F.char_length(g)).alias("start"), F.right(g, F.lit(NEAR)).alias("gap"), F.left(F.get(p["gaps"], i + 1), F.lit(NEAR)).alias("after")),
            ),
        )
        return F.when(n == 0, none()).otherwise(let(running(lengths, lambda a, x: a + x, F.lit(0)), place))

    return let(parts, of)


def none() -> Column:
    return F.array().cast(f"array<{MATCH}>")
