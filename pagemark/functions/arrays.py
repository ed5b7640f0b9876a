"""Helpers the column functions are built with, above all ``let`` and ``running``."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A plain reuse of a Column repeats its expression, and the optimizer inlines a
    projected column into lambdas, where it would run once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


_PLAIN = re.compile(r"Column<'(?![xyz]_\d+')[A-Za-z_][\w.]*'>")
_BUILT: dict[tuple, Column] = {}
MOST_BUILT = 512


def reused(function: Callable[..., Column]) -> Callable[..., Column]:
    """Build the Column once per session when its inputs are plain column names.

    A large expression takes thousands of calls into the JVM to build, and a Column
    does not belong to any DataFrame, so the same one can be used again.
    """
    @functools.wraps(function)
    def build(*args, **options):
        shown = [str(a) if isinstance(a, Column) else None for a in args]
        plain = all(s is None or _PLAIN.fullmatch(s) for s in shown)
        context = SparkContext._active_spark_context
        if not plain or context is None:
            return function(*args, **options)
        inputs = tuple(a if s is None else s for a, s in zip(args, shown))
        key = (function.__module__, function.__qualname__, inputs,
               tuple(sorted(options.items())), context.applicationId)
        if key not in _BUILT:
            if len(_BUILT) >= MOST_BUILT:
                _BUILT.clear()
            _BUILT[key] = function(*args, **options)
        return _BUILT[key]

    return build


def constant_map(pairs: dict[str, str]) -> Column:
    """A lookup table that is one literal in the plan, however many entries it has."""
    text = "\x02".join(f"{key}\x01{value}" for key, value in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def strict_json(text: Column) -> Column:
    """The JSON value of a text as VARIANT; NULL if there is anything besides it.

    The parser stops after the first value, so the text is read as the only element
    of an array.
    """
    def only(items: Column) -> Column:
        return F.when(F.size(items) == 1, F.get(items, F.lit(0)))

    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(F.try_variant_get(wrapped, "$", "array<variant>"), only)


def join(parts: Column) -> Column:
    return F.array_join(parts, "")


def running(
    items: Column,
    start: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    element_type: str,
) -> Column:
    """Running fold: an array with ``emit(state, item)`` for each item.

    ``step(state, item)`` gives the next state (same type as ``start``), ``emit``
    sees the state *after* its item. ``aggregate`` alone would copy the whole output
    for each item; working in chunks keeps the copying at n * sqrt(n).
    """
    empty = F.array().cast(f"array<{element_type}>")
    nested_empty = F.array().cast(f"array<array<{element_type}>>")

    def one(acc: Column, item: Column) -> Column:
        return let(
            step(acc["state"], item),
            lambda state: F.struct(
                state.alias("state"),
                F.concat(acc["out"], F.array(emit(state, item))).alias("out"),
            ),
        )

    def over(bound: Column) -> Column:
        def chunk(acc: Column, first: Column) -> Column:
            done = F.aggregate(
                F.slice(bound, first, F.lit(CHUNK)),
                F.struct(acc["state"].alias("state"), empty.alias("out")),
                one,
            )
            return let(
                done,
                lambda d: F.struct(
                    d["state"].alias("state"),
                    F.concat(acc["out"], F.array(d["out"])).alias("out"),
                ),
            )

        firsts = F.sequence(F.lit(1), F.greatest(F.size(bound), F.lit(1)), F.lit(CHUNK))
        chunks = F.aggregate(
            firsts, F.struct(start.alias("state"), nested_empty.alias("out")), chunk
        )
        return F.when(F.size(bound) > 0, F.flatten(chunks["out"])).otherwise(empty)

    return let(items, over)
