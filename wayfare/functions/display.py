"""Colour ramps, bands and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DISTANCE_M = 5000
DEFAULT_YELLOW_MIN = 15
# fixed values: colours of the distance and time ramps, near to far
COLORS = ("#006837", "#39b54a", "#c7e62c", "#ffe34d", "#ff9f1c", "#ef476f", "#7a001f")
RAMP = tuple(tuple(int(c[k : k + 2], 16) for k in (1, 3, 5)) for c in COLORS)
DISTANCE_STOPS = (0, 500, 750, 1000, 2500, 3750, MAX_DISTANCE_M)


def time_scale(yellow: Column) -> tuple[Column, Column, Column]:
    """Yellow, orange and red minutes: yellow rounded and kept in 1 to 120, 15 if it is no number; twice, four times."""
    fine = yellow.isNotNull() & ~F.isnan(yellow.cast("double")) & (F.abs(yellow.cast("double")) < float("inf"))
    y = F.when(fine, F.greatest(F.lit(1), F.least(F.lit(120), F.floor(yellow.cast("double") + 0.5).cast("int")))).otherwise(F.lit(DEFAULT_YELLOW_MIN))
    return y, y * 2, y * 4


def time_stops(yellow: Column) -> list[Column]:
    y, orange, red = time_scale(yellow)
    return [F.lit(0.0), y / 2, y * 0.75, y.cast("double"), orange.cast("double"), (orange + red) / 2, red.cast("double")]


def _piecewise(value: Column, stops: list[Column], outputs: list[float]) -> Column:
    out = F.lit(float(outputs[0]))
    for (s1, o1), (s2, o2) in zip(zip(stops, outputs, strict=True), zip(stops[1:], outputs[1:], strict=True), strict=False):
        out = F.when(value >= s1, F.lit(float(o1)) + (value - s1) / (s2 - s1) * F.lit(float(o2 - o1))).otherwise(out)
    return F.when(value >= stops[-1], F.lit(float(outputs[-1]))).otherwise(out)


def ramp(value: Column, stops: list[Column] | tuple[int, ...]) -> Column:
    """#rrggbb between the stops' colours, those of the ends beyond."""
    at = [F.lit(float(s)) if isinstance(s, (int, float)) else s for s in stops]
    parts = [F.lower(F.lpad(F.hex(F.floor(_piecewise(value.cast("double"), at, [c[k] for c in RAMP]) + 0.5).cast("long")), 2, "0")) for k in range(3)]
    return F.concat(F.lit("#"), *parts)


def distance_color(metres: Column) -> Column:
    return ramp(metres, DISTANCE_STOPS)


def time_color(minutes: Column, yellow: Column) -> Column:
    return ramp(minutes, time_stops(yellow))


def tile_distance(metres: Column, precision: int = 25, most: int = MAX_DISTANCE_M) -> Column:
    """To the nearest multiple of precision; most + 1 beyond the range."""
    return F.when(metres > most, F.lit(most + 1)).otherwise((F.floor(metres / precision + 0.5) * precision).cast("int")).cast("int")


def clamped_distance(metres: Column, most: int = MAX_DISTANCE_M) -> tuple[Column, Column]:
    """The distance up to the range, and 1 where it was beyond."""
    return F.least(metres, F.lit(most)), F.when(metres > most, F.lit(1))


def format_integer(value: Column) -> Column:
    """Rounded, with commas between thousands."""
    return F.format_number(F.floor(value + 0.5).cast("long"), 0)


def format_distance(metres: Column, binary: bool = False) -> Column:
    """Whole metres under 950, else kilometres with a decimal: halves up, or as printf() has it, by the binary value and its halves to even (1,950 m are 1.9 km)."""
    km = metres.cast("double") / 1000
    shown = F.call_function("format_number", km, F.lit("0.0")) if binary else F.format_string("%.1f", km)
    return F.when(metres < 950, F.concat(F.floor(metres + 0.5).cast("long").cast("string"), F.lit(" m"))).otherwise(F.concat(shown, F.lit(" km")))


def format_minutes(minutes: Column) -> Column:
    """Exact to 10 minutes, then to the nearest 5; from 90 on in hours and minutes."""
    shown = F.when(minutes < 10, F.floor(minutes + 0.5).cast("int")).otherwise((F.floor(minutes / 5 + 0.5) * 5).cast("int"))
    rest = F.pmod(shown, F.lit(60))
    long = F.concat(F.floor(shown / 60).cast("string"), F.lit(" hr"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(" min"))).otherwise(F.lit("")))
    return F.when(minutes >= 90, long).otherwise(F.concat(shown.cast("string"), F.lit(" min")))


def format_clock(minutes: Column) -> Column:
    """HH:MM of minutes since midnight."""
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.floor(F.pmod(minutes, F.lit(60)) + 0.5).cast("int"))


def departure(now: Column, zone: str) -> tuple[Column, Column]:
    """Weekday (Monday is 0) and minute of the day of a UTC instant in a time zone."""
    local = F.from_utc_timestamp(now, zone)
    return F.weekday(local), F.hour(local) * 60 + F.minute(local)
