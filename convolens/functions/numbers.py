"""Safe arithmetic, formats of sizes and times, and vector functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, 0 where b is 0 or null."""
    x = F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return x if digits is None else F.round(x, digits)


def numeric(text: Column) -> Column:
    """A string's number, null if it is none."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def human_size(size: Column) -> Column:
    """Bytes in the largest unit up to TB that leaves at least 1, one decimal."""
    out = F.format_string("%.1f PB", size / float(1 << 50))
    for unit, power in (("TB", 40), ("GB", 30), ("MB", 20), ("KB", 10), ("B", 0)):
        out = F.when(size < float(1 << (power + 10)), F.format_string(f"%.1f {unit}", size / float(1 << power))).otherwise(out)
    return F.when(size.isNotNull(), out)


def clock(seconds: Column) -> Column:
    """MM:SS."""
    s = F.floor(seconds)
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def hms(seconds: Column) -> Column:
    """'Hh Mm Ss'."""
    s = F.floor(seconds)
    return F.when(seconds.isNotNull(), F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def parse_duration(text: Column) -> Column:
    """Seconds of 'HH:MM:SS', 'MM:SS' or 'S'; null for anything else."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.try_to_number(p, F.lit("999999999999")).cast("bigint"))
    ok = F.trim(text).rlike(r"^\d{1,12}(:\d{1,12}){0,2}$")
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 60 + p))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, 0 if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return ratio(dot, norm(a) * norm(b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
