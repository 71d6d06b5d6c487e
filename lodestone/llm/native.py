"""Spans of regular expressions with built-in functions only.

Positions are code points.  Patterns are written so that Java matches them in
one pass over any text: possessive quantifiers, and a look-behind that lets a
run be tried at its first character only (``\\G`` also admits the end of the
previous match).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose lengths are summed at once; keeps prefix sums of n matches at n * (n / 256 + 256) steps.
STRIDE = 256
#: Code points of a chunk of a text that pieces are cut from.
CHUNK = 1024

SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once: a lambda's variable isn't expanded as an expression would be."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def largest(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: F.greatest(a, x))


def running(numbers: Column, of: Callable[[Column], Column] = total, both: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running totals (or what ``of`` and ``both`` make of them) of a non-empty array of ints that aren't negative."""
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(numbers) - 1) / STRIDE).cast("int")), lambda b: of(F.slice(numbers, b * STRIDE + 1, STRIDE)))
    return let(
        blocks,
        lambda known: F.transform(
            numbers,
            lambda _, i: both(of(F.slice(known, F.lit(1), F.floor(i / STRIDE).cast("int"))), of(F.slice(numbers, F.floor(i / STRIDE).cast("int") * STRIDE + 1, i % STRIDE + 1))),
        ),
    )


def spans(text: Column, pattern: str, context: int = 0, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches (those whose value passes ``keep``) as array<struct<start,end,value,before,after>>.

    ``before`` and ``after`` hold the ``context`` code points beside the match, other
    matches included (they have two code points at least).  No match, or null text: an empty array.
    """
    none = F.expr(f"cast(array() as {SPAN})")

    def build(found: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        # pieces that reach over the context whatever they hold
        reach = context // 2 + 1

        def before(i: Column) -> Column:
            first = F.greatest(i - reach, F.lit(0)).cast("int")
            parts = F.zip_with(F.slice(gaps, first + 1, (i - first + 1).cast("int")), F.slice(found, first + 1, (i - first).cast("int")), lambda g, m: F.concat(F.substring(g, -context, context), F.coalesce(F.substring(m, -context, context), F.lit(""))))
            return F.substring(F.array_join(parts, ""), -context, context)

        def after(i: Column) -> Column:
            parts = F.zip_with(F.slice(gaps, (i + 2).cast("int"), F.lit(reach + 1)), F.slice(found, (i + 2).cast("int"), F.lit(reach)), lambda g, m: F.concat(F.coalesce(F.substring(g, 1, context), F.lit("")), F.coalesce(F.substring(m, 1, context), F.lit(""))))
            return F.substring(F.array_join(parts, ""), 1, context)

        def one(end: Column, i: Column) -> Column:
            value = F.get(found, i)
            return F.struct(
                (end - F.length(value)).cast("int").alias("start"),
                end.cast("int").alias("end"),
                value.alias("value"),
                (before(i) if context else F.lit("")).alias("before"),
                (after(i) if context else F.lit("")).alias("after"),
            )

        if keep is None:
            return F.transform(let(lengths, lambda x: running(x)), one)
        passing = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: keep(F.get(found, i)))
        return let(let(lengths, lambda x: running(x)), lambda ends: F.transform(passing, lambda i: one(F.get(ends, i), i)))

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: build(found, gaps).cast(SPAN))),
    )


def joined(items: Column) -> Column:
    """kind:start:end of each struct, comma-joined."""
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text that is given in chunks of CHUNK."""
    first = F.floor(start / CHUNK).cast("int")
    some = F.array_join(F.slice(chunks, first + 1, (F.floor(end / CHUNK) - first + 1).cast("int")), "")
    return F.when(end > start, F.substr(some, (start % CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def replaced(text: Column, items: Column) -> Column:
    """The text with each span of ``items`` (structs start, end, label) replaced by its label; overlapping spans become one, with the first's label.

    Steps grow with spans and text, not with their product: the text is cut into chunks first."""
    ordered = F.array_sort(F.transform(items, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label"))))

    def merged(o: Column, reach: Column) -> Column:
        """Spans that don't overlap; reach: the furthest end so far, span by span."""
        starts = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | (F.get(o, i)["start"] >= F.get(reach, i - 1)))
        return let(starts, lambda k: F.transform(k, lambda i, n: F.struct(F.get(o, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(k, n + 1), F.size(o)) - 1).alias("end"), F.get(o, i)["label"].alias("label"))))

    def write(m: Column, chunks: Column) -> Column:
        before = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
        pieces = F.transform(m, lambda s, i: F.concat(cut(chunks, before(i), s["start"]), s["label"]))
        return F.concat(F.array_join(pieces, ""), cut(chunks, F.element_at(m, -1)["end"], F.length(text)))

    spans_of = let(ordered, lambda o: let(running(F.transform(o, lambda s: s["end"]), largest, F.greatest), lambda reach: merged(o, reach)))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(items) > 0, let(spans_of, lambda m: let(chunks, lambda c: write(m, c)))).otherwise(text)
