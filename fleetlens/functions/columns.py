"""Numeric, text and time expressions with the semantics the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that identify one member of the fleet. A frame that carries them is
#: processed per member; a frame without them is one member.
FLEET_KEYS = ("instance_id",)

_WIDE = "decimal(38,0)"


def fleet_keys(*frames: DataFrame) -> list[str]:
    """The fleet keys that the frames carry; they join every grouping and join key.

    Frames of one operator must agree: a join of one frame per member with one
    without members would mix the members up.
    """
    out = []
    for k in FLEET_KEYS:
        carried = [k in f.columns for f in frames]
        if any(carried) and not all(carried):
            raise ValueError(f"some of the frames carry {k!r} and some do not")
        if all(carried):
            out.append(k)
    return out


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def int_div(a: Column | str, b: Column | str) -> Column:
    """Division of whole numbers that truncates, NULL when the divisor is 0."""
    return F.call_function("try_divide", c(a).cast(_WIDE) - c(a).cast(_WIDE) % F.nullif(c(b).cast(_WIDE), F.lit(0)),
                           F.nullif(c(b).cast(_WIDE), F.lit(0))).cast("bigint")


def int_div0(a: Column | str, b: Column | str) -> Column:
    """`int_div`, 0 when the divisor is 0."""
    return F.coalesce(int_div(a, b), F.lit(0).cast("bigint"))


def ratio(num: Column | str, den: Column | str, digits: int = 2, scale: int = 1) -> Column:
    """`scale * num / den` for whole numbers and a positive divisor, rounded half
    away from zero to `digits`.

    Works on 38-digit decimals, so the result does not depend on the order in
    which floating-point sums were formed, and is NULL for a zero divisor.
    """
    n, d = c(num).cast(_WIDE), F.nullif(c(den).cast(_WIDE), F.lit(0))
    twice = F.abs(n) * F.lit(2 * scale * 10**digits).cast("decimal(20,0)") + d
    whole = int_div(twice, d * F.lit(2).cast("decimal(1,0)"))
    return F.when(n < 0, -whole).otherwise(whole).cast("double") / F.lit(float(10**digits))


def wide(col: Column | str) -> Column:
    """A whole number widened so that fleet totals cannot overflow."""
    return c(col).cast("decimal(28,0)")


def wide_sum(col: Column | str) -> Column:
    return F.sum(wide(col))


def long_sum(col: Column | str) -> Column:
    return F.coalesce(F.sum(c(col)), F.lit(0)).cast("bigint")


def minute_boundaries(a: Column | str, b: Column | str, unit: str = "MINUTE") -> Column:
    """Number of unit boundaries crossed between two times (not elapsed units)."""
    return F.timestamp_diff(unit, F.date_trunc(unit, c(a)), F.date_trunc(unit, c(b)))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return minute_boundaries(a, b, "SECOND")


def as_time(value: Column | str) -> Column:
    """A literal `as_of` moment as a zone-free timestamp; columns pass through."""
    if isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    return value


def one_line(text: Column | str, length: int) -> Column:
    """The first characters of a text without line breaks."""
    return F.translate(F.substring(c(text), 1, length), "\r\n", "")


def statement_text(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """The statement that two byte offsets into a two-byte-per-character text mark.

    An end offset of -1 means "to the end of the text".
    """
    first = (int_div(start, F.lit(2)) + 1).cast("int")
    stop = F.when(c(end) == -1, F.length(c(text)) * 2).otherwise(c(end))
    return F.substr(c(text), first, F.greatest((int_div(stop - c(start), F.lit(2)) + 1).cast("int"), F.lit(0)))


def pad(value: Column, width: int) -> Column:
    """Zero padding that never cuts a longer number."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def clock_text(ms: Column | str) -> Column:
    """Milliseconds as `dd hh:mm:ss.mss`."""
    ms = c(ms)
    return F.concat(
        pad(int_div(ms, F.lit(86400000)), 2), F.lit(" "),
        pad(int_div(ms, F.lit(3600000)) % 24, 2), F.lit(":"),
        pad(int_div(ms, F.lit(60000)) % 60, 2), F.lit(":"),
        pad(int_div(ms, F.lit(1000)) % 60, 2), F.lit("."), pad(ms % 1000, 3),
    )


def day_clock_text(ms: Column | str) -> Column:
    """Milliseconds as `Nd hh:mm:ss`."""
    ms = c(ms)
    return F.concat(
        int_div(ms, F.lit(86400000)).cast("string"), F.lit("d "),
        pad(int_div(ms, F.lit(3600000)) % 24, 2), F.lit(":"),
        pad(int_div(ms, F.lit(60000)) % 60, 2), F.lit(":"),
        pad(int_div(ms, F.lit(1000)) % 60, 2),
    )


def spoken_duration(seconds: Column | str) -> Column:
    """Seconds as `h hour(s), m min, s sec`."""
    s = c(seconds)
    return F.concat(
        int_div(s, F.lit(3600)).cast("string"), F.lit(" hour(s), "),
        int_div(s % 3600, F.lit(60)).cast("string"), F.lit(" min, "),
        (s % 60).cast("string"), F.lit(" sec"),
    )


def agent_timestamp(run_date: Column | str, run_time: Column | str) -> Column:
    """Whole numbers YYYYMMDD and HHMMSS as one zone-free timestamp."""
    d, t = c(run_date).cast("bigint"), c(run_time).cast("bigint")
    return F.make_timestamp_ntz(
        int_div(d, F.lit(10000)).cast("int"), (int_div(d, F.lit(100)) % 100).cast("int"), (d % 100).cast("int"),
        int_div(t, F.lit(10000)).cast("int"), (int_div(t, F.lit(100)) % 100).cast("int"), (t % 100).cast("decimal(8,6)"),
    )


def agent_seconds(run_duration: Column | str) -> Column:
    """A whole number HHMMSS (hours may exceed 24) in seconds."""
    t = c(run_duration).cast("bigint")
    return int_div(t, F.lit(10000)) * 3600 + (int_div(t, F.lit(100)) % 100) * 60 + t % 100


def agent_duration_text(run_duration: Column | str) -> Column:
    """A whole number HHMMSS as `HH:MM:SS`."""
    t = c(run_duration).cast("bigint")
    return F.concat(pad(int_div(t, F.lit(10000)), 2), F.lit(":"), pad(int_div(t, F.lit(100)) % 100, 2), F.lit(":"), pad(t % 100, 2))


def coded(col: Column | str, texts: dict, default: str | None = None) -> Column:
    """Translate a code by a fixed table."""
    out = None
    for code, text in texts.items():
        test = c(col) == F.lit(code)
        out = F.when(test, text) if out is None else out.when(test, text)
    return out.otherwise(F.lit(default).cast("string"))


def starts_with(longer: Column | str, shorter: Column | str) -> Column:
    """True when one array is a prefix of the other."""
    return F.slice(c(longer), F.lit(1), F.size(c(shorter))) == c(shorter)


def bracket(name: Column | str) -> Column:
    """A name in brackets, closing brackets doubled."""
    return F.concat(F.lit("["), F.replace(c(name), F.lit("]"), F.lit("]]")), F.lit("]"))


_EPOCH = "1970-01-01 00:00:00"


def micros(time: Column | str) -> Column:
    """Microseconds of a zone-free timestamp since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), c(time))


def to_instant(time: Column | str) -> Column:
    """A zone-free timestamp, taken as UTC, as an instant (watermarks need one)."""
    return F.timestamp_micros(micros(time))


def from_instant(time: Column | str) -> Column:
    """An instant as a zone-free timestamp in UTC."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c(time)), F.lit(_EPOCH).cast("timestamp_ntz"))
