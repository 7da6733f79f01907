"""Scalar expressions that jobs use, all as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Runs of white space as Python's ``str.split`` knows it: Unicode's, and the four separators below the blank.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column | str) -> Column:
    """Words between runs of white space (any that Unicode knows); no empty ones."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def free(name: str, *taken: str) -> str:
    """``name``, or it with as many underscores before as no column has."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name = "_" + name
    return name


def number(value: Column | str) -> Column:
    """A text as a double, null where it is none. Python's digit separators are taken, type suffixes are not."""
    text = F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))
    plain = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    return F.when(~plain.rlike(r"[0-9.][fFdD]$"), plain.try_cast("double"))


def exact(value: Column | str, scale: int = 2) -> Column:
    """Money-like doubles as decimals, so that sums do not depend on order."""
    return (F.col(value) if isinstance(value, str) else value).cast(f"decimal(18,{scale})")


def default(value: Column | str, other) -> Column:
    """The value, or ``other`` where it is null."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(other) if not isinstance(other, Column) else other)


def json_field(text: Column | str, path: str, kind: str = "string") -> Column:
    """One field of a JSON text, null where it is missing or cannot be cast."""
    return F.get_json_object(text, path).try_cast(kind)


def to_json(*columns) -> Column:
    return F.to_json(F.struct(*columns))


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since the epoch; timestamps without zone count as UTC (the session's zone)."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def nearest_ms(ts: Column | str) -> Column:
    """The time rounded to whole milliseconds, halves away from the epoch, as DuckDB's ``epoch_ms`` does; ``epoch_ms`` rounds down."""
    us = F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
    us += F.when(us < 0, -500).otherwise(500)
    return F.timestamp_micros(us - us % 1000)


def bucket_ms(ms: Column, size: int) -> Column:
    """Start of the bucket of ``size`` ms that a time lies in, aligned with the epoch; right for negative times too."""
    return ms - F.pmod(ms, F.lit(size))


def round_half_even(value: Column, digits: int) -> Column:
    """Rounding of the exact decimal value, halves to even."""
    return F.bround(value.cast("decimal(38,15)"), digits).cast("double")


def clamp_running_max(ts: Column, window) -> Column:
    return F.greatest(ts, F.max(ts).over(window))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def clock_text() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


# -- rules -------------------------------------------------------------------

#: Bounds beyond which sensors and weather are anomalous.
SENSOR_LOW, SENSOR_HIGH = 15, 30
STRICT_LOW, STRICT_HIGH, HUMIDITY_LOW, HUMIDITY_HIGH, ERROR_VALUE = 10, 35, 20, 80, -999.9
WEATHER_LOW, WEATHER_HIGH, WIND_HIGH, STORM_CODE = 0, 35, 50, 95
#: Labels of weather codes.
WEATHER = {
    0: "Clear", 1: "Mainly Clear", 2: "Partly Cloudy", 3: "Overcast", 45: "Foggy", 48: "Rime Fog",
    51: "Light Drizzle", 53: "Drizzle", 55: "Heavy Drizzle", 61: "Light Rain", 63: "Rain", 65: "Heavy Rain",
    71: "Light Snow", 73: "Snow", 75: "Heavy Snow", 80: "Rain Showers", 95: "Thunderstorm", 96: "Thunderstorm w/ Hail",
}


def sensor_anomaly(temperature: Column, flag: Column | None = None) -> Column:
    """Flagged by the sensor, or outside 15 to 30 degrees."""
    rule = (temperature > SENSOR_HIGH) | (temperature < SENSOR_LOW)
    return rule if flag is None else F.coalesce(flag, F.lit(False)) | rule


def strict_sensor_anomaly(temperature: Column, humidity: Column) -> Column:
    """Temperature outside 10 to 35, humidity outside 20 to 80, or the error value -999.9."""
    return (temperature < STRICT_LOW) | (temperature > STRICT_HIGH) | (humidity < HUMIDITY_LOW) | (humidity > HUMIDITY_HIGH) | (temperature == ERROR_VALUE)


def weather_anomaly(temperature: Column, wind: Column, code: Column) -> Column:
    return (temperature > WEATHER_HIGH) | (temperature < WEATHER_LOW) | (wind > WIND_HIGH) | (code >= STORM_CODE)


def weather_label(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in WEATHER.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("Unknown"))


def histogram_bucket(value: Column, bounds: list[float]) -> Column:
    """Index of the first bound that the value does not exceed, or the number of bounds."""
    out = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[k], F.lit(k)).otherwise(out)
    return out
