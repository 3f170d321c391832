"""Matches of a pattern with their places, from Spark functions only.

Work grows in proportion to the matches of a text: places are running sums taken in blocks of ``BLOCK``, and overlaps are
found by bisection, so that a text of some hundred thousand matches is no special case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:int,start:int,end:int,match:string,before:string>"
CONTEXT = 32
BLOCK = 256


def let(c: Column, what: Callable[[Column], Column]) -> Column:
    """``what(c)`` with c worked out once, however often it is used."""
    return F.get(F.transform(F.array(c), what), F.lit(0))


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All leftmost non-overlapping matches; ``gate`` is a cheap condition that any match needs."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if gate is None else F.when(gate, found).otherwise(F.expr("cast(array() as array<string>)"))


def _sums(items: Column, base: Column, size: Callable[[Column], Column]) -> Column:
    """base, base + size(items[0]), ...: one sum for each item, without that item. The items should be few."""
    start = F.struct(base.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def running(lengths: Column) -> Column:
    """The sums of the lengths before each; ``lengths`` must not be empty."""
    add = lambda a, x: a + x

    def over(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(own), F.lit(BLOCK)), lambda at: F.slice(own, at, F.lit(BLOCK)))

        def inner(cut: Column) -> Column:
            bases = _sums(cut, F.lit(0), lambda block: F.aggregate(block, F.lit(0), add))
            return F.flatten(F.zip_with(cut, bases, lambda block, base: _sums(block, base, lambda x: x)))

        return let(blocks, inner)

    return let(lengths, over)


def placed(text: Column, found: Column, pattern: str, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Spans (code points, end exclusive) of the ``found`` matches that are valid, with the text just before each.

    The gaps that ``split`` leaves around the same matches give the places.
    """
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def spans(pieces: Column) -> Column:
        at = running(F.transform(pieces, lambda x: F.char_length(x["gap"]) + F.char_length(x["match"])))
        with_place = F.zip_with(pieces, at, lambda x, p: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), (p + F.char_length(x["gap"])).alias("start")))
        kept = F.filter(with_place, lambda x: valid(x["match"]))
        return F.transform(kept, lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.char_length(x["match"])).alias("end"), x["match"].alias("match"),
            F.lower(F.right(x["gap"], F.lit(CONTEXT))).alias("before")))

    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("match"))
    return F.when(F.size(found) > 0, let(zipped, spans)).otherwise(none)


def _overlaps(span: Column, others: Column) -> Column:
    """Whether the span meets one of others, which are sorted and apart from one another: by bisection."""
    rounds = F.sequence(F.lit(1), F.char_length(F.bin(F.size(others).cast("long"))))
    start = F.struct(F.lit(0).alias("lo"), F.size(others).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        before = F.get(others, mid)["end"] <= span["start"]
        here = acc["lo"] < acc["hi"]
        return F.struct(F.when(here & before, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(here & ~before, mid).otherwise(acc["hi"]).alias("hi"))

    first = F.aggregate(rounds, start, halve, lambda acc: acc["lo"])
    return F.coalesce(F.get(others, first)["start"] < span["end"], F.lit(False))


def apart(spans: Column, others: list[Column]) -> Column:
    """The spans that overlap none of the others, given as one array for each kind, as ``placed`` makes them."""
    return let(F.array(*others), lambda kinds: F.filter(spans, lambda s: ~F.exists(kinds, lambda own: _overlaps(s, own))))


def joined(spans: Column, names: list[str], by_kind: bool) -> Column:
    """kind:start:end, comma-joined: by kind then start, or by start then kind."""
    first, second = ("kind", "start") if by_kind else ("start", "kind")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s[first].alias("a"), s[second].alias("b"), s["end"].alias("end"), s["kind"].alias("kind"), s["start"].alias("start"))))
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
