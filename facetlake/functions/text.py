"""Small string expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode blanks included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def iso_utc(seconds: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of seconds since 1970, whatever the session's zone."""
    day = F.floor(seconds / 86400).cast("long")
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"),
        two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit("Z"),
    )


def month_of(seconds: Column) -> Column:
    return iso_utc(seconds).substr(1, 7)


def local_us(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp read as UTC, by its printed form, so no session zone takes part."""
    s = ts.cast("string")
    days = F.unix_date(F.to_date(s.substr(1, 10)))
    sec = s.substr(12, 2).cast("long") * 3600 + s.substr(15, 2).cast("long") * 60 + s.substr(18, 2).cast("long")
    frac = F.rpad(F.coalesce(F.nullif(s.substr(21, 6), F.lit("")), F.lit("0")), 6, "0").cast("long")
    return (days.cast("long") * 86400 + sec) * 1_000_000 + frac


def instant_seconds(text: Column) -> Column:
    """Whole seconds since 1970 of an ISO text with Z or an offset; NULL for anything that is no instant."""
    t = strip(text)
    zoned = t.rlike(r"([Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2})$") & t.rlike(r"\d[Tt ]\d")
    return F.floor(F.unix_micros(F.when(zoned, t).try_cast("timestamp")) / 1_000_000).cast("long")


def uri_key(uri: Column) -> Column:
    """What a link names: the part behind the last '#', or of a urn behind the last ':', percent-decoded; else NULL."""
    u = strip(uri)
    raw = (
        F.when(F.instr(u, "#") > 0, F.substring_index(u, "#", -1))
        .when(F.lower(u).startswith("urn:"), F.substring_index(u, ":", -1))
    )
    # A '+' is no blank here, and a '%' without two hex digits stays as it is.
    kept = F.regexp_replace(F.regexp_replace(raw, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(kept)
