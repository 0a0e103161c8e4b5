"""14-digit capture timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyyMMddHHmmss"
_FILL = "00010101000000"


def parse(ts: Column) -> Column:
    """A timestamp from exactly 14 digits that name a real instant, else null."""
    return F.when(ts.rlike("^[0-9]{14}$"), F.try_to_timestamp(ts, F.lit(FORMAT)))


def is_valid(ts: Column) -> Column:
    return F.coalesce(parse(ts).isNotNull(), F.lit(False))


def pad(ts: Column) -> Column:
    """A partial timestamp filled up to its earliest instant; longer ones are cut."""
    return F.when(F.length(ts) >= 14, F.substring(ts, 1, 14)).otherwise(F.concat(ts, F.substring(F.lit(_FILL), F.length(ts) + 1, F.lit(14))))


def distance(a: Column, b: Column, metric: str = "digits") -> Column:
    """Between two 14-digit timestamps: as numbers, or in seconds."""
    if metric == "digits":
        return F.abs(a.try_cast("bigint") - b.try_cast("bigint"))
    return F.abs(F.unix_timestamp(parse(a)) - F.unix_timestamp(parse(b)))


def day_bounds(first: str | None, last: str | None) -> tuple[str | None, str | None]:
    """Bounds from 8-digit days; what is no day or instant is ignored."""
    own = lambda x, fill: x + fill if x and len(x) == 8 and x.isdigit() else x if x and len(x) == 14 and x.isdigit() else None
    return own(first, "000000"), own(last, "235959")


def to_unix(ts: Column) -> Column:
    return F.unix_timestamp(parse(ts))


def display(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``; anything but 14 digits stays as it is."""
    return F.regexp_replace(ts, r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$", "$1-$2-$3 $4:$5:$6")


def from_iso(iso: Column) -> Column:
    """14 digits from an ISO 8601 instant, 14 zeros if it is none."""
    return F.coalesce(F.date_format(iso.try_cast("timestamp"), FORMAT), F.lit("0" * 14))
