"""Spans of regular-expression matches as native columns (code points, end exclusive)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """step over all values up to each place, that place included. The values are taken in parts of about the root of
    their number, so that the work grows with its power 1.5 and not with its square."""

    def parts(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int"))
        folded = F.transform(numbers, lambda i: F.aggregate(F.slice(v, i * width + 1, width), zero, step))
        inside = lambda part, start: F.transform(part, lambda _, j: F.aggregate(F.slice(part, F.lit(1), j + 1), start, step))
        whole = lambda sums: F.flatten(F.transform(numbers, lambda i: bound(F.aggregate(F.slice(sums, F.lit(1), i), zero, step), lambda start: bound(F.slice(v, i * width + 1, width), lambda part: inside(part, start)))))
        return bound(folded, whole)

    return F.when(F.size(values) > 0, bound(values, parts)).otherwise(F.slice(F.array(zero), 1, 0))


def located(text: Column, regex: str, kind: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of regex, those that fail `keep` dropped after they were consumed.

    The pieces between matches come from split() and the matches from
    regexp_extract_all(): their lengths, summed from the left, are the offsets.
    """

    def spans(hits: Column) -> Column:
        gaps = F.slice(F.split(text, regex, -1), F.lit(1), F.size(hits))
        ends = running(F.zip_with(gaps, hits, lambda gap, hit: F.length(gap) + F.length(hit)), lambda a, x: a + x, F.lit(0))
        made = F.zip_with(hits, ends, lambda hit, end: F.struct((end - F.length(hit)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("value")))
        return F.filter(made, lambda s: keep(s["value"])) if keep else made

    found = bound(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), spans)
    return F.when(F.rlike(text, F.lit(regex)), found.cast(SPAN)).otherwise(no_spans())


def free_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, by start. Both arrays are merged; the furthest end before a span and the next start from it on decide."""
    of = lambda part, s: F.when(s["tag"] == 0, s["span"][part])
    tagged = lambda side, tag: F.transform(side, lambda s: F.struct(s["start"].alias("at"), F.lit(tag).alias("tag"), s.alias("span")))

    def judged(merged: Column) -> Column:
        reach = running(F.transform(merged, lambda s: F.coalesce(of("end", s), F.lit(0))), lambda a, x: F.greatest(a, x), F.lit(0))
        ahead = F.reverse(running(F.reverse(F.transform(merged, lambda s: F.coalesce(of("start", s), F.lit(2**31 - 1)))), lambda a, x: F.least(a, x), F.lit(2**31 - 1)))
        rows = F.zip_with(merged, F.arrays_zip(reach.alias("reach"), ahead.alias("ahead")), lambda s, r: F.struct(s.alias("s"), r["reach"].alias("reach"), r["ahead"].alias("ahead")))
        return F.transform(F.filter(rows, lambda r: (r["s"]["tag"] == 1) & (r["reach"] <= r["s"]["at"]) & (r["ahead"] >= r["s"]["span"]["end"])), lambda r: r["s"]["span"])

    return F.when(F.size(others) == 0, spans).when(F.size(spans) == 0, spans).otherwise(bound(F.array_sort(F.concat(tagged(others, 0), tagged(spans, 1))), judged))


def listed(spans: Column) -> Column:
    """kind:start:end of each span by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each maximal run of overlapping spans replaced by the kind of its first one in brackets."""

    def pieces(sorted_: Column) -> Column:
        return bound(running(F.transform(sorted_, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0)), lambda reached: put(sorted_, reached))

    def put(sorted_: Column, reached: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(reached))).cast("int")
        before = lambda i: F.when(i > 0, F.get(reached, i - 1)).otherwise(0)

        def of_part(i: Column) -> Column:  # spans are cut from the part of the text they lie in, since cutting takes time with the place
            start, stop = before(i * width), F.get(reached, F.least((i + 1) * width, F.size(reached)) - 1)
            piece = lambda own, s, k: F.when(s["start"] >= before(k), F.concat(F.substring(own, before(k) - start + 1, s["start"] - before(k)), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
            return bound(F.substring(text, start + 1, stop - start), lambda own: F.array_join(F.transform(F.slice(sorted_, i * width + 1, width), lambda s, j: piece(own, s, i * width + j)), ""))

        numbers = F.sequence(F.lit(0), F.floor((F.size(reached) - 1) / width).cast("int"))
        return F.concat(F.array_join(F.transform(numbers, of_part), ""), F.substring(text, F.element_at(reached, -1) + 1, F.lit(2**31 - 1)))

    return F.when(F.size(spans) == 0, text).otherwise(bound(F.array_sort(spans), pieces))
