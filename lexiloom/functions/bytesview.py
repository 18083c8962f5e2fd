"""Byte strings as Spark strings: one character per byte (ISO-8859-1), and byte-level expressions.

``length``, ``substring``, ``left``, ``right`` and ``instr`` then count bytes, and strings compare like bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN = "ISO-8859-1"


def from_text(c: Column) -> Column:
    """The bytes of a text column's UTF-8 form."""
    return F.decode(F.encode(c, "UTF-8"), LATIN)


def from_binary(c: Column) -> Column:
    return F.decode(c, LATIN)


def to_binary(c: Column) -> Column:
    return F.encode(c, LATIN)


def to_hex(c: Column) -> Column:
    return F.hex(to_binary(c))


def to_text(c: Column) -> Column:
    """Back to text; bytes that are no UTF-8 raise."""
    return F.decode(to_binary(c), "UTF-8")


def max_overlap(left: Column, right: Column) -> Column:
    """Longest n >= 1 so that the last n bytes of ``left`` are the first n of ``right`` (all of both allowed), else 0."""
    most = F.least(F.length(left), F.length(right))
    sizes = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda n: F.right(left, n) == F.left(right, n))
    return F.coalesce(F.array_max(fits), F.lit(0))


def bits_needed(n: Column) -> Column:
    """Width of ``n`` in bits; 0 takes one."""
    return F.length(F.bin(n))


def uleb128_size(n: Column) -> Column:
    return F.ceil(bits_needed(n) / 7).cast("int")


def uleb128_hex(n: Column) -> Column:
    """Unsigned LEB128 of a non-negative long as upper-case hex."""
    last = uleb128_size(n) - 1

    def group(i: Column) -> Column:
        low = F.call_function("shiftrightunsigned", n, (i * 7).cast("int"))
        return F.lpad(F.hex(low.bitwiseAND(F.lit(127)) + F.when(i < last, 128).otherwise(0)), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), last), group), "")


def prefix_function(c: Column) -> Column:
    """For each prefix of a byte string, the length of its longest proper border (an array)."""
    places = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))

    def border(n: Column) -> Column:
        sizes = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.array_max(F.filter(sizes, lambda b: F.left(c, b) == F.substring(c, n - b + 1, b))), F.lit(0))

    return F.transform(places, border)


def unescape_separator(flag: str) -> bytes:
    """The separator that a command-line flag names: escapes n, t, r, a, b, f, v, backslash, quotes, NUL as \\0, \\xHH, \\ooo, \\uXXXX.

    Anything else that starts with a backslash stands for itself.  An empty separator is refused.
    """
    import re

    plain = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"', "0": "\0"}

    def one(m: re.Match) -> bytes:
        x = m[1]
        if x[0] == "x":
            return bytes([int(x[1:], 16)])
        if x[0] == "u":
            return chr(int(x[1:], 16)).encode()
        if len(x) == 3:
            return bytes([int(x, 8) & 255])
        return plain[x].encode()

    out, at = b"", 0
    for m in re.finditer(r"""\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-3][0-7]{2}|[ntrabfv\\'"0])""", flag):
        out += flag[at : m.start()].encode() + one(m)
        at = m.end()
    out += flag[at:].encode()
    if not out:
        raise ValueError("empty separator")
    return out
