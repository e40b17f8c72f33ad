"""Numbers, flags and dates as publishers write them; what can't be read is null, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The publishers' time zone, and their spellings of flags.
ZONE = "Asia/Jerusalem"
TRUE, FALSE = ("1", "true", "yes", "y", "כן"), ("0", "false", "no", "n", "לא")
#: Formats of times without an offset, in the order they are tried.
LOCAL_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "MM/dd/yyyy hh:mm:ss a", "yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd",
)


def decimal_of(text: Column, scale: int = 4, least: str | None = "0", most: str | None = "9999999999.9999") -> Column:
    """A decimal within bounds. No-break spaces go; one comma without a point stands before the fraction, other commas group thousands."""
    bare = F.regexp_replace(F.trim(text), "\u00a0", "")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    plain = F.when((commas == 1) & ~bare.contains("."), F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    value = plain.try_cast(f"decimal(38,{scale})")
    ok = plain.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")
    if least is not None:
        ok &= value >= F.lit(least).cast(f"decimal(38,{scale})")
    if most is not None:
        ok &= value <= F.lit(most).cast(f"decimal(38,{scale})")
    return F.when(ok, value)


def int_of(text: Column) -> Column:
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("int"))


def flag_of(text: Column) -> Column:
    bare = F.lower(F.trim(text))
    return F.when(bare.isin(*TRUE), F.lit(True)).when(bare.isin(*FALSE), F.lit(False))


def instant_of(text: Column, zone: str = ZONE) -> Column:
    """The instant (session in UTC) of a time with an offset, or of a local one; null for local times that a clock change skips or repeats."""
    bare = F.trim(text)
    offset = F.when(bare.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & bare.rlike("T"), bare.try_cast("timestamp"))
    local = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in LOCAL_FORMATS])

    def sure(wall: Column) -> Column:
        instant = F.to_utc_timestamp(wall, zone)
        later = lambda hours: F.from_utc_timestamp(instant + F.expr(f"INTERVAL {hours} HOURS"), zone)
        return F.when((later(0) == wall) & (later(1) != wall) & (later(-1) != wall), instant)

    return F.coalesce(offset, F.transform(F.array(local), sure)[0])  # by a name, so that the time is parsed once


def instant_of_parts(date: Column, time: Column, zone: str = ZONE) -> Column:
    """A date and a time; the time may hold a date itself, and without any date there is no instant."""
    has_date = time.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}")
    both = F.when(has_date, time).when(date.isNotNull(), F.concat_ws(" ", F.substring_index(F.trim(date), "T", 1), F.trim(time)))
    return instant_of(both, zone)


def listing_instant(text: Column) -> Column:
    """The instant of a listing's time, which is written like 1/31/2024 4:05:06 PM."""
    bare = F.trim(text)
    parts = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{1,2}):([0-9]{2}):([0-9]{2}) ([AaPp][Mm])$"
    padded = F.concat(*[x for k, sep in ((1, "/"), (2, "/"), (3, " "), (4, ":"), (5, ":"), (6, " "), (7, "")) for x in (F.lpad(F.regexp_extract(bare, parts, k), 2 if k != 3 else 4, "0"), F.lit(sep))])
    return F.when(bare.rlike(parts), instant_of(F.upper(padded)))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def nearest_rank(values: Column, percent: int) -> Column:
    """The percent-th percentile of an array by nearest rank."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.greatest(F.lit(1), F.ceil(F.size(ordered) * percent / 100)).cast("int"))
