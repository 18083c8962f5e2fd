"""Native expressions over long arrays inside one row: bindings, running values and marked spans, without quadratic folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two private-use marks around a match, and the symbol of one code point that stands for them where a text holds them itself.
OPEN, SHUT, BLANK = "\ue000", "\ue001", "\u00a4"
#: A fold appends to at most so many values before it starts a new part.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression; Catalyst would inline it into every lambda call."""
    return F.transform(F.array(value), body)[0]


def unmarked(held: Column) -> Column:
    """``held`` without the two marks; null is empty."""
    text = F.coalesce(held.cast("string"), F.lit(""))
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(SHUT)), F.translate(text, OPEN + SHUT, BLANK + BLANK)).otherwise(text)


def _fold(values: Column, op) -> Column:
    empty = F.array().cast("array<long>")
    return F.aggregate(values, empty, lambda a, x: F.array_append(a, F.coalesce(op(F.get(a, F.size(a) - 1), x), x)))


def plus(a: Column, b: Column) -> Column:
    return a + b


def scan(values: Column, op=plus) -> Column:
    """Running values (the own one included) of the associative ``op`` over an array of longs.

    Parts of ``CHUNK`` values are folded on their own and shifted by the parts before, so a row of n values costs n * CHUNK and not n * n.
    """

    def parts(v: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / CHUNK)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: _fold(F.slice(v, k * CHUNK + 1, F.lit(CHUNK)), op))

    def joined(p: Column) -> Column:
        ends = _fold(F.filter(F.transform(p, lambda x: F.get(x, F.size(x) - 1)), lambda x: x.isNotNull()), op)
        return let(ends, lambda e: F.flatten(F.transform(p, lambda x, k: F.transform(x, lambda v: F.coalesce(op(F.get(e, k - 1), v), v)))))

    return let(values, lambda v: let(parts(v), joined))


def pieces(text: Column, pattern: str, mark: str = f"{OPEN}$0{SHUT}") -> Column:
    """``text`` (without marks of its own) cut before each match of ``pattern``: what comes first, then match, mark and what follows."""
    return F.split(F.regexp_replace(text, pattern, mark), OPEN)


def starts(cut: Column) -> Column:
    """Where in the text each piece after the first begins, in code points."""
    sizes = F.transform(cut, lambda p, i: (F.length(p) - F.when(i > 0, 1).otherwise(0)).cast("long"))
    return scan(sizes)


def matched(piece: Column) -> Column:
    return F.substring_index(piece, SHUT, 1)


def rest(piece: Column) -> Column:
    """What follows the match in a piece."""
    return F.substring(piece, F.length(matched(piece)) + 2, F.length(piece))
