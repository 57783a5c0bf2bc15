"""Offsets in texts: UTF-16 units, as scripts count them, and UTF-8 bytes. All are built-in functions on columns.

An offset inside a character counts as the character's start."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "UTF-16BE"


def _units(text: Column) -> Column:
    """The number of UTF-16 units."""
    return (F.octet_length(F.encode(text, WIDE)) / 2).cast("int")


def _floor(coded: Column, at: Column, unit: int, low: str, high: str) -> Column:
    """``at`` (in units of so many bytes), or one less where a character goes on there."""
    first = F.hex(F.substr(coded, unit * at + 1, F.lit(1)))
    return F.when((at > 0) & first.between(low, high), at - 1).otherwise(at)


def slice_units(text: Column, start: Column, end: Column) -> Column:
    """The part between two UTF-16 offsets; empty where they don't rise, and cut off at the end of the text."""
    coded = F.encode(text, WIDE)
    start, end = (_floor(coded, at, 2, "DC", "DF") for at in (start, end))
    part = F.decode(F.substr(coded, 2 * start + 1, F.greatest(2 * (end - start), F.lit(0))), WIDE)
    return F.when(start >= end, F.lit("")).otherwise(part)


def unit_to_byte(text: Column, offset: Column) -> Column:
    """The UTF-8 byte at which a UTF-16 offset lies; the length in bytes beyond the end."""
    return F.octet_length(slice_units(text, F.lit(0), offset))


def span_of_byte(text: Column, byte: Column) -> Column:
    """(line, column, offset) of a UTF-8 byte: lines from 1, columns and offset in UTF-16 units. Bytes beyond the end count one each."""
    coded, whole = F.encode(text, "UTF-8"), byte
    for _ in range(3):
        whole = _floor(coded, whole, 1, "80", "BF")
    before = F.decode(F.substr(coded, F.lit(1), whole), "UTF-8")
    more = F.greatest(byte - F.octet_length(text), F.lit(0))
    line = 1 + F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.struct(line.alias("line"), (_units(F.substring_index(before, "\n", -1)) + more).alias("column"), (_units(before) + more).alias("offset"))
