"""Search predicates as columns; combine them with ``&``, ``|`` and :func:`none_of`."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions import geo
from loomframe.functions.casts import let
from loomframe.functions.text import tokens

# Days per duration unit (a month is 30 days, a year 365).
DURATIONS = {
    "SECONDS": timedelta(seconds=1),
    "MINUTES": timedelta(minutes=1),
    "HOURS": timedelta(hours=1),
    "DAYS": timedelta(days=1),
    "WEEKS": timedelta(weeks=1),
    "MONTHS": timedelta(days=30),
    "YEARS": timedelta(days=365),
}


def eq(c: Column, value: Any) -> Column:
    return c == F.lit(value)


def gt(c: Column, value: Any) -> Column:
    return _typed(c, value) > F.lit(value)


def gte(c: Column, value: Any) -> Column:
    return _typed(c, value) >= F.lit(value)


def lt(c: Column, value: Any) -> Column:
    return _typed(c, value) < F.lit(value)


def lte(c: Column, value: Any) -> Column:
    return _typed(c, value) <= F.lit(value)


def _typed(c: Column, value: Any) -> Column:
    """Text bounds compare as text, numbers and times by their own order."""
    return c.cast("string") if isinstance(value, str) else c


def is_null(c: Column, wanted: bool = True, blank_counts: bool = False) -> Column:
    """Missing; with ``blank_counts`` also the texts "" and "None"."""
    missing = c.isNull()
    if blank_counts:
        missing = missing | c.cast("string").isin("", "None")
    return missing if wanted else ~missing


def contains(c: Column, value: Any) -> Column:
    """An array column holds the value."""
    return F.array_contains(c, F.lit(value))


def is_in(c: Column, values: Sequence[Any]) -> Column:
    return c.isin(*values)


def _terms(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def contains_any_term(c: Column, query: str) -> Column:
    return F.arrays_overlap(tokens(c), F.array(*[F.lit(t) for t in _terms(query)]))


def contains_all_terms(c: Column, query: str) -> Column:
    wanted = F.array(*[F.lit(t) for t in _terms(query)])
    return F.size(F.array_except(wanted, tokens(c))) == 0


def _line(c: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))


def contains_all_terms_in_order(c: Column, query: str) -> Column:
    """The terms as a phrase."""
    return F.contains(_line(c), F.lit(f" {' '.join(_terms(query))} "))


def contains_all_terms_in_order_prefix_last_term(c: Column, query: str) -> Column:
    """The terms as a phrase whose last word may go on."""
    return F.contains(_line(c), F.lit(f" {' '.join(_terms(query))}"))


def starts_with(c: Column, prefix: str) -> Column:
    return c.cast("string").startswith(prefix)


def wildcard(c: Column, pattern: str) -> Column:
    """``*`` any run, ``?`` one character, over the whole value."""
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern.strip())
    return c.cast("string").rlike(f"(?s)^{body}$")


def regex(c: Column, pattern: str) -> Column:
    """The whole value matches."""
    return c.cast("string").rlike(f"^(?:{pattern.strip()})$")


def relative_date_range(
    c: Column, now: datetime, start: tuple[int, str], end: tuple[int, str] = (0, "SECONDS")
) -> Column:
    """Between ``now - start`` and ``now - end``, both ends included, in either order."""
    bounds = sorted(now - n * DURATIONS[unit] for n, unit in (start, end))
    return c.between(*[F.lit(b).cast("timestamp_ntz") for b in bounds])


def none_of(p: Column) -> Column:
    """Negation that keeps rows whose field is missing."""
    return ~F.coalesce(p, F.lit(False))


# Word intervals. Each builder gives an array of struct(s, e, w): first and last word
# position and the number of matched words in between.

_INTERVALS = "array<struct<s:int,e:int,w:int>>"


def word(c: Column, term: str) -> Column:
    places = F.transform(tokens(c), lambda t, i: F.when(t == F.lit(term), F.struct(i.alias("s"), i.alias("e"), F.lit(1).alias("w"))))
    return F.array_compact(places).cast(_INTERVALS)


def _soonest(options: Column, start: Column) -> Column:
    """The interval that begins at or after ``start`` and ends first."""
    later = F.filter(options, lambda o: o["s"] >= start)
    ends = F.transform(later, lambda o: F.struct(o["e"].alias("e"), o["s"].alias("s"), o["w"].alias("w")))
    return F.array_min(ends)


def _within(gaps: Column, max_gaps: int) -> Column:
    return gaps <= max_gaps if max_gaps >= 0 else gaps.isNotNull()


def all_of(parts: Sequence[Column], max_gaps: int = -1, ordered: bool = False) -> Column:
    """Intervals holding every part, with at most ``max_gaps`` unmatched words (-1: any)."""
    names = [f"p{i}" for i in range(len(parts))]
    combine = _ordered if ordered else _unordered
    # The parts are bound once; inside the loops over them they are plain lookups.
    bound = F.struct(*[part.alias(n) for n, part in zip(names, parts)])
    made = let(bound, lambda env: combine([env[n] for n in names]))
    return F.filter(made, lambda i: i["w"].isNotNull() & _within(i["e"] - i["s"] + 1 - i["w"], max_gaps))


def _ordered(parts: Sequence[Column]) -> Column:
    def follow(state: Column, options: Column) -> Column:
        def step(current: Column) -> Column:
            def joined(coming: Column) -> Column:
                words = current["w"] + coming["w"]
                return F.struct(current["s"].alias("s"), coming["e"].alias("e"), words.alias("w"))

            return let(_soonest(options, current["e"] + 1), joined)

        return let(state, step)

    def extend(first: Column) -> Column:
        state = first
        for options in parts[1:]:
            state = follow(state, options)
        return state

    return F.transform(parts[0], extend).cast(_INTERVALS)


def _unordered(parts: Sequence[Column]) -> Column:
    starts = F.array_distinct(F.transform(F.concat(*parts), lambda o: o["s"]))

    def cover(start: Column) -> Column:
        chosen = [_soonest(options, start) for options in parts]
        return let(
            F.array(*chosen),
            lambda hits: F.struct(
                start.alias("s"),
                F.when(~F.exists(hits, lambda h: h.isNull()), F.array_max(F.transform(hits, lambda h: h["e"]))).alias("e"),
                F.when(
                    ~F.exists(hits, lambda h: h.isNull()),
                    F.aggregate(hits, F.lit(0), lambda n, h: n + h["w"]),
                ).alias("w"),
            ),
        )

    return F.transform(starts, cover).cast(_INTERVALS)


def any_of(parts: Sequence[Column]) -> Column:
    return F.concat(*parts)


def match(c: Column, query: str, max_gaps: int = -1, ordered: bool = False) -> Column:
    """Intervals that hold the query's terms, found in one pass over the words.

    Each interval is the shortest one that ends at its last word.
    """
    terms = _terms(query)
    if len(terms) == 1:
        return word(c, terms[0])
    if len(set(terms)) < len(terms):
        return all_of([word(c, t) for t in terms], max_gaps, ordered)
    known = F.array(*[F.lit(t) for t in terms])
    hits = F.filter(
        F.transform(
            tokens(c), lambda t, i: F.struct(i.alias("i"), F.array_position(known, t).cast("int").alias("k"))
        ),
        lambda h: h["k"] > 0,
    )
    names = [f"b{n}" for n in range(1, len(terms) + 1)]
    nothing = F.lit(None).cast("int")
    start = F.struct(*[nothing.alias(n) for n in names], F.array().cast(_INTERVALS).alias("out"))

    def step(state: Column, hit: Column) -> Column:
        # Ordered: b_k is the latest start of a run of the first k terms. Unordered: the last
        # place of term k.
        marks = []
        for n, name in enumerate(names, 1):
            mark = hit["i"] if n == 1 or not ordered else state[names[n - 2]]
            marks.append(F.when(hit["k"] == n, mark).otherwise(state[name]))
        if ordered:
            first, done = marks[-1], (hit["k"] == len(terms)) & marks[-1].isNotNull()
        else:
            first = F.least(*marks)
            done = F.array_position(F.array(*[m.isNull() for m in marks]), True) == 0
        close = _within(hit["i"] - first + 1 - len(terms), max_gaps)
        found = F.struct(first.alias("s"), hit["i"].alias("e"), F.lit(len(terms)).alias("w"))
        out = F.when(done & close, F.concat(state["out"], F.array(found))).otherwise(state["out"])
        return F.struct(*[m.alias(n) for m, n in zip(marks, names)], out.cast(_INTERVALS).alias("out"))

    return F.aggregate(hits, start, step, lambda s: s["out"])


def interval(found: Column) -> Column:
    """True when any interval was found."""
    return F.size(found) > 0


within_distance_of = geo.within_distance
within_bounding_box = geo.within_box
within_polygon = geo.within_polygon
intersects_bounding_box = geo.boxes_intersect
intersects_polygon = geo.ring_intersects


def does_not_intersect_bounding_box(*args: Any) -> Column:
    return ~geo.boxes_intersect(*args)


def does_not_intersect_polygon(ring: Column, polygon: Sequence[geo.Point]) -> Column:
    return ~geo.ring_intersects(ring, polygon)
