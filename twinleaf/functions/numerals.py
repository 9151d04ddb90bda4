"""Chinese numerals: tables of small numbers and of numbers below 10,000, made from a rule."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits and units.
DIGITS = "零一二三四五六七八九"
UNITS = ("", "十", "百", "千")


def positional(value: int) -> str | None:
    """A number from 0 to 9,999 by position: one zero for each inner gap, and no one before the
    leading ten of 10 to 19."""
    if not 0 <= value < 10_000:
        return None
    places = [(int(d), UNITS[p]) for p, d in zip(range(len(str(value)) - 1, -1, -1), str(value))]
    while len(places) > 1 and places[-1][0] == 0:
        places.pop()
    runs = [list(g) for _, g in groupby(places, key=lambda x: x[0] == 0)]
    text = "".join(DIGITS[0] if r[0][0] == 0 else "".join(DIGITS[d] + u for d, u in r) for r in runs)
    return text.removeprefix("一") if 10 <= value < 20 else text


def short(value: int) -> str | None:
    """The usual form of a number from 0 to 100."""
    return "百" if value == 100 else positional(value) if 0 <= value < 100 else None


def short_column(value: Column, least: int = 0, most: int = 100) -> Column:
    """short of an integer column; null outside least..most."""
    table = F.split(F.lit(",".join(short(i) or "" for i in range(least, most + 1))), ",")
    return F.when(value.between(least, most), F.get(table, value.cast("int") - least))
