"""Text functions over strings and over bytes, with the widths of fixed-width text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that strip takes off, for bytes and for text.
ASCII_SPACE = "\t\n\x0b\x0c\r "
UNICODE_SPACE = ASCII_SPACE + "\x1c\x1d\x1e\x1f\x85\xa0                　"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Text:
    """The functions on columns of one family. Bytes go through ISO 8859-1, a character a byte."""

    def __init__(self, family: str):
        self.bytes = family == "S"

    def read(self, x: Column) -> Column:
        return F.decode(x, "ISO-8859-1") if self.bytes else x

    def write(self, x: Column) -> Column:
        return F.encode(x, "ISO-8859-1") if self.bytes else x

    def width(self, x: Column, width: int | None) -> Column:
        return x if width is None else F.substring(x, 1, width)

    def lower(self, x: Column) -> Column:
        if self.bytes:
            return F.translate(x, UPPER, LOWER)
        # character by character, so that a final sigma is like any other
        return F.when(x.contains("Σ"), F.array_join(F.transform(F.split(x, ""), F.lower), "")).otherwise(F.lower(x))

    def upper(self, x: Column) -> Column:
        return F.translate(x, LOWER, UPPER) if self.bytes else F.upper(x)

    def strip(self, x: Column) -> Column:
        return F.btrim(x, self.space)

    def lstrip(self, x: Column) -> Column:
        return F.ltrim(x, self.space)

    def rstrip(self, x: Column) -> Column:
        return F.rtrim(x, self.space)

    @property
    def space(self) -> Column:
        return F.lit(ASCII_SPACE if self.bytes else UNICODE_SPACE)

    def removeprefix(self, x: Column, p: Column) -> Column:
        return F.when(F.startswith(x, p), x.substr(F.length(p) + 1, F.length(x))).otherwise(x)

    def removesuffix(self, x: Column, p: Column) -> Column:
        return F.when(F.endswith(x, p), x.substr(F.lit(1), F.length(x) - F.length(p))).otherwise(x)

    def replace(self, x: Column, old: Column, new: Column) -> Column:
        return F.replace(x, old, new)

    def substr(self, x: Column, start: int, count: int) -> Column:
        """From 0; a negative start counts from the end, and stops at the beginning."""
        at = F.lit(start) if start >= 0 else F.greatest(F.length(x) + start, F.lit(0))
        return x.substr(at + 1, F.lit(max(count, 0)))

    def split_part(self, x: Column, mark: Column, part: int) -> Column:
        """What stands before the first mark (all, without one), or all that stands after it."""
        place = F.call_function("locate", mark, x)
        if part <= 0:
            return F.when(place == 0, x).otherwise(x.substr(F.lit(1), place - 1))
        return F.when(place == 0, F.lit("")).otherwise(x.substr(place + F.length(mark), F.length(x)))
