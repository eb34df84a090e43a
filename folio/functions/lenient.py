"""Values as users and presets write them, read leniently: what can't be read is the default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for yes and no, besides true, false and whole numbers.
YES, NO = ("yes", "y", "on"), ("no", "n", "off")
CLOSE = 1e-4


def boolean(value: Column, default: bool) -> Column:
    """True, false, a whole number (0 is false), or a word for yes or no, in any case; otherwise the default."""
    s = F.lower(F.trim(value))
    whole = F.when(s.rlike(r"^[+-]?[0-9]{1,9}$"), s.cast("int") != 0)
    named = F.when(s.isin("true", *YES), True).when(s.isin("false", *NO), False)
    return F.coalesce(whole, named, F.lit(default))


def double(value: Column, default: float) -> Column:
    """A decimal number, with or without thousands separated by commas."""
    s = F.regexp_replace(F.trim(value), r"(?<=[0-9]),(?=[0-9]{3}(?:[^0-9]|$))", "")
    read = F.when(s.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), s.cast("double"))
    return F.coalesce(read, F.lit(float(default)))


def integer(value: Column, default: int) -> Column:
    """A number rounded half to even."""
    read = double(value, float("nan"))
    return F.coalesce(F.when(~F.isnan(read) & (F.abs(read) < 2.0**31), F.bround(read, 0).cast("int")), F.lit(default))


def clamped(value: Column, least: float | None, most: float | None) -> Column:
    out = value if least is None else F.greatest(value, F.lit(float(least)))
    return out if most is None else F.least(out, F.lit(float(most)))


def stepped(value: Column, step: float, times: Column, least: float | None, most: float | None) -> Column:
    """The value after so many steps up (or down), kept in its range; a change under ``CLOSE`` is none."""
    to = clamped(value + F.lit(float(step)) * times, least, most)
    return F.when(F.abs(to - value) < CLOSE, value).otherwise(to)


def option(options: list[str], at: Column) -> Column:
    """The option of an index that is kept within the list; of no options, null."""
    if not options:
        return F.lit(None).cast("string")
    return F.element_at(F.array(*map(F.lit, options)), (F.greatest(F.lit(0), F.least(F.lit(len(options) - 1), at)) + 1).cast("int"))
