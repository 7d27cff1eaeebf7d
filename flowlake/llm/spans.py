"""Spans of regex matches as columns, shared by the secret and personal-data scans.

A span is (start, end, at, kind) in code points, end exclusive; ``at`` orders the kinds. Matches are
leftmost and don't overlap within a kind. Spark has no function that gives the places of all
matches, so they are running sums of the lengths of what lies between the matches (``split``) and
of the matches themselves (``regexp_extract_all``); both walk the text the same way. The sums are
taken in blocks, so that a text with very many matches costs no square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlake.llm.common import let

SPAN = "array<struct<start:int,end:int,at:int,kind:string>>"
FOUND = "array<struct<start:int,end:int,found:string>>"
BLOCK = 200


def sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it."""

    def plain(values: Column, start: Column) -> Column:
        empty = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(values, empty, add, lambda acc: acc["out"])

    def blocked(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
        total = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)
        return let(
            blocks,
            lambda bs: let(
                plain(F.transform(bs, total), F.lit(0)),
                lambda starts: F.flatten(F.transform(bs, lambda b, i: plain(b, F.get(starts, i)))),
            ),
        )

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(blocked(lengths))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, found) of every match; ``found`` is the group's text."""

    def placed(gaps: Column, whole: Column, found: Column) -> Column:
        lengths = F.transform(whole, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def span(m: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.get(found, i).alias("found"))

        return let(sums_before(lengths), lambda before: F.transform(whole, lambda m, i: span(m, i, before)))

    parts = F.array(F.split(text, pattern, -1), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in dict.fromkeys((0, group))])
    hit = F.when(text.rlike(pattern), let(parts, lambda p: placed(p[0], p[1], p[2 if group else 1])))
    return F.coalesce(hit, F.array().cast(FOUND))


def spans(text: Column, kind: str, order: int, pattern: str, group: int = 0, keep: Callable[[Column], Column] | None = None) -> Column:
    """The spans of one kind; ``keep`` drops matches by the text of ``group``."""
    found = matches(text, pattern, group)
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["found"]))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(order).alias("at"), F.lit(kind).alias("kind")))


def joined(found: Column) -> Column:
    """``kind:start:end`` of all spans by start, then by kind as listed, comma-joined."""
    by_place = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["at"].alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(by_place, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, found: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with every span replaced by ``mark(span)``; overlapping spans become one, marked as the first."""

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["to"]
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        grown = F.array_append(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), last.withField("end", s["end"]))
        kept = F.when(new, F.array_append(acc["out"], s)).when(s["end"] <= acc["to"], acc["out"]).otherwise(grown)
        return F.struct(kept.alias("out"), F.greatest(acc["to"], s["end"]).alias("to"))

    def rebuilt(parts: Column) -> Column:
        """``parts``: the spans to replace, in order, none overlapping."""
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(parts, i - 1)["end"])
        pieces = F.transform(parts, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), mark(s)))
        last = F.get(parts, F.size(parts) - 1)["end"]
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    empty = F.struct(F.array().cast(SPAN).alias("out"), F.lit(0).alias("to"))
    chosen = F.aggregate(F.sort_array(found), empty, step, lambda acc: acc["out"])
    return F.when(F.size(found) == 0, text).otherwise(let(chosen, rebuilt))
