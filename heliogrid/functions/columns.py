"""Column expressions: time, units, humidity, wind, sun, losses, quantiles.

All are plain expressions, so they stay inside whole-stage code generation.
Missing values are NULL throughout; a division by zero gives NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_MICROS = 900_000_000
SLOT_HOURS = 0.25
SOLAR_CONSTANT = 1361.0
QUANTILES = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x: float) -> Column:
    return F.lit(float(x))


def clip(x, low: float, high: float) -> Column:
    """x held in [low, high]; NULL stays NULL."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lit(low)), lit(high)))


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


# --- time -------------------------------------------------------------------


def slot_index(ts) -> Column:
    """Absolute number of the 15-minute slot."""
    return F.floor(F.unix_micros(col(ts)) / SLOT_MICROS).cast("long")


def slot_start(idx) -> Column:
    return F.timestamp_micros(col(idx) * F.lit(SLOT_MICROS))


def nearest_slot(ts) -> Column:
    """Slot whose start is nearest to a jittered sensing time."""
    return F.floor((F.unix_micros(col(ts)) + SLOT_MICROS // 2) / SLOT_MICROS).cast("long")


def lead_hours(issue, target) -> Column:
    return (F.unix_micros(col(target)) - F.unix_micros(col(issue))) / lit(3.6e9)


def valid_time(issue, step_hours) -> Column:
    """issue and a possibly fractional number of hours."""
    return F.timestamp_micros(F.unix_micros(col(issue)) + (col(step_hours) * lit(3.6e9)).cast("long"))


def local_time(ts, zone) -> Column:
    return F.from_utc_timestamp(col(ts), col(zone))


def local_to_utc(local, zone, occurrence) -> Column:
    """Wall clock to UTC. Of an ambiguous time, odd occurrences are the later one."""
    first = F.to_utc_timestamp(col(local), col(zone))
    later = first + F.expr("INTERVAL 1 HOUR")
    again = (F.from_utc_timestamp(later, col(zone)) == col(local)) & (col(occurrence) % 2 == 1)
    return F.when(again, later).otherwise(first)


def harmonics(ts) -> dict[str, Column]:
    """Sine and cosine of the first two harmonics of the year and of the day."""
    t = col(ts)
    day = (F.hour(t) * 60 + F.minute(t)) / lit(1440)
    year = (F.dayofyear(t) + day) / lit(365.25)
    return {f"{name}_{f}_{k}": getattr(F, f)(lit(2 * math.pi * k) * phase) for name, phase in (("year", year), ("day", day)) for k in (1, 2) for f in ("sin", "cos")}


# --- production --------------------------------------------------------------


def capacity_factor(energy_mwh, capacity_mw) -> Column:
    """Energy of a slot over what the capacity gives in it; a capacity of 0 or less is an error."""
    good = F.when(col(capacity_mw) > 0, col(capacity_mw)).otherwise(F.raise_error(F.lit("capacity must be positive")).cast("double"))
    return col(energy_mwh) / (good * lit(SLOT_HOURS))


def power_to_energy(kw) -> Column:
    return col(kw) / lit(1000) * lit(SLOT_HOURS)


# --- weather -----------------------------------------------------------------


def kelvin_to_celsius(x) -> Column:
    return col(x) - lit(273.15)


def pascal_to_hpa(x) -> Column:
    return col(x) / lit(100)


def metres_to_mm(x) -> Column:
    return col(x) * lit(1000)


def fraction_to_percent(x) -> Column:
    return col(x) * lit(100)


def relative_humidity(temperature_c, dewpoint_c) -> Column:
    t, d = col(temperature_c), col(dewpoint_c)
    return clip(lit(100) * F.exp(lit(17.625) * d / (lit(243.04) + d) - lit(17.625) * t / (lit(243.04) + t)), 0, 100)


def wind_speed(u, v) -> Column:
    return F.hypot(col(u), col(v))


def wind_direction(u, v) -> Column:
    return F.pmod(lit(270) - F.degrees(F.atan2(col(v), col(u))), lit(360))


# --- sun ---------------------------------------------------------------------


def _sind(x):
    return F.sin(F.radians(x))


def _cosd(x):
    return F.cos(F.radians(x))


def solar_position(ts, lat, lon) -> tuple[Column, Column]:
    """(azimuth, refraction-corrected elevation) in degrees at a UTC time; parts of a second don't count."""
    t, lat, lon = col(ts), col(lat), col(lon)
    days = (F.unix_seconds(t) - F.lit(946728000)) / lit(86400)  # since 2000-01-01 12:00
    century = days / lit(36525)
    turn = lambda x: F.pmod(x, lit(360))
    mean_lon = turn(lit(280.46646) + lit(36000.76983) * century + lit(0.0003032) * century * century)
    anomaly = turn(lit(357.52911) + lit(35999.05029) * century - lit(0.0001537) * century * century)
    centre = (
        (lit(1.914602) - lit(0.004817) * century - lit(0.000014) * century * century) * _sind(anomaly)
        + (lit(0.019993) - lit(0.000101) * century) * _sind(lit(2) * anomaly)
        + lit(0.000289) * _sind(lit(3) * anomaly)
    )
    ecliptic = turn(mean_lon + centre)
    tilt = lit(23.439291) - lit(0.0130042) * century - lit(0.00000016) * century * century + lit(0.000000504) * century * century * century
    ascension = turn(F.degrees(F.atan2(_cosd(tilt) * _sind(ecliptic), _cosd(ecliptic))))
    declination = F.asin(_sind(tilt) * _sind(ecliptic))
    sidereal = turn(lit(280.46061837) + lit(360.98564736629) * days + lit(0.000387933) * century * century - century * century * century / lit(38710000))
    hour = turn(sidereal + lon - ascension)
    phi = F.radians(lat)
    sin_e = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * _cosd(hour)
    elevation = F.degrees(F.asin(clip(sin_e, -1, 1)))
    cos_a = F.try_divide(F.sin(declination) - F.sin(phi) * sin_e, F.cos(phi) * _cosd(elevation))
    azimuth = F.degrees(F.acos(clip(cos_a, -1, 1)))
    azimuth = F.when(hour > 180, lit(360) - azimuth).otherwise(azimuth)
    lifted = elevation + lit(0.0167) / F.tan(F.radians(elevation + lit(10.3) / (elevation + lit(5.11))))
    return azimuth, F.when(elevation > -1, lifted).otherwise(elevation)


def clear_sky_ghi(elevation) -> Column:
    """W/m2 on the horizontal under a clear sky; 0 at night."""
    e = col(elevation)
    zenith = lit(90) - e
    mass = lit(1) / (_cosd(zenith) + lit(0.50572) * F.pow(lit(96.07995) - zenith, lit(-1.6364)))
    return F.when(e > 0, lit(SOLAR_CONSTANT) * _sind(e) * F.pow(lit(0.7), F.pow(mass, lit(0.678)))).otherwise(lit(0))


# --- losses and quantiles ------------------------------------------------------


def point_loss(name: str, prediction, actual) -> Column:
    """One row's loss by the name of a profile: mse, mse_heavy, balanced, mae_heavy or mae."""
    e = col(prediction) - col(actual)
    square, size = e * e, F.abs(e)
    huber = F.when(size <= 1, lit(0.5) * square).otherwise(size - lit(0.5))
    profiles = {
        "mse": square,
        "mse_heavy": lit(0.75) * square + lit(0.25) * huber,
        "balanced": lit(0.5) * square + lit(0.5) * huber,
        "mae_heavy": lit(0.75) * size + lit(0.25) * square,
        "mae": size,
    }
    return profiles[name]


def pinball(q: float, prediction, actual) -> Column:
    e = col(actual) - col(prediction)
    return F.greatest(lit(q) * e, lit(q - 1) * e)


def quantile_name(q: float) -> str:
    return f"q{round(q * 100):02d}"


def monotone_quantiles(values) -> Column:
    """An array held in [0, 1] and sorted, so that quantiles don't cross."""
    return F.array_sort(F.transform(col(values), lambda x: F.least(F.greatest(x, lit(0)), lit(1))))
