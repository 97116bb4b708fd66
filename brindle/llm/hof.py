"""Helpers for building native column expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value evaluated once, however often body uses it.
    Plain column references may be inlined into lambdas by the optimizer and
    then run again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are one of the ASCII ``chars``."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def prefix_sums(items: Column, step: Callable[[Column], Column], emit: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """``emit(offset, item)`` for each item, where offset is the sum of
    ``step`` over the items before it. Two levels of blocks keep the copying
    of growing arrays to n * (block + n / block**2) steps."""
    empty = F.array().cast(f"array<{kind}>")

    def inner(start: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(start.alias("at"), empty.alias("out")),
            lambda a, x: F.struct((a["at"] + step(x)).alias("at"), F.array_append(a["out"], emit(a["at"], x)).alias("out")),
        )

    def outer(all_items: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / block).cast("int"))
        folded = F.aggregate(
            blocks,
            F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")),
            lambda a, b: let(
                inner(a["at"], F.slice(all_items, b * block + 1, F.lit(block))),
                lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out")),
            ),
        )
        return F.flatten(folded["out"])

    return let(items, lambda x: F.when(F.size(x) > 0, outer(x)).otherwise(empty))
