"""Scalar expressions: columns in, columns out. No UDFs, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataframe.functions import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def wrap_lon(lon, max_lon: float = 180.0) -> Column:
    """Longitude in [max_lon - 360, max_lon)."""
    lon = _c(lon)
    return F.when(lon >= max_lon, lon - 360).when(lon < max_lon - 360, lon + 360).otherwise(lon)


def melt_rate(flux) -> Column:
    """Freshwater flux (kg/m2/s, upwards positive) to melt in m per year."""
    return -_c(flux) / K.RHO_FRESH * K.SECONDS_PER_YEAR


def _isometric(lat: Column, e: float) -> Column:
    s = e * F.sin(lat)
    return F.tan(math.pi / 4 - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))


def _scale(e: float, lat_c: float) -> tuple[float, float]:
    s = math.sin(lat_c)
    t = math.tan(math.pi / 4 - lat_c / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
    return t, math.cos(lat_c) / math.sqrt(1 - (e * s) ** 2)


def polar_stereographic(lon, lat, a: float = K.ELLIPSOID_AXIS, e: float = K.ELLIPSOID_ECCENTRICITY, lat_c: float = K.STANDARD_LATITUDE, lon0: float = 0.0) -> tuple[Column, Column]:
    """(x, y) in metres; the hemisphere is that of ``lat_c``."""
    pole = -1.0 if lat_c < 0 else 1.0
    lam, phi = F.radians(_c(lon) * pole), F.radians(_c(lat) * pole)
    t_c, m_c = _scale(e, math.radians(lat_c * pole))
    rho, turn = a * m_c / t_c * _isometric(phi, e), lam - math.radians(lon0 * pole)
    return pole * rho * F.sin(turn), -pole * rho * F.cos(turn)


def polar_stereographic_inverse(x, y, a: float = K.ELLIPSOID_AXIS, e: float = K.ELLIPSOID_ECCENTRICITY, lat_c: float = K.STANDARD_LATITUDE, lon0: float = 0.0, rounds: int = 8) -> tuple[Column, Column]:
    """(lon, lat) in degrees; ``rounds`` fixed-point steps for the latitude, far below 1e-12 after 8."""
    pole = -1.0 if lat_c < 0 else 1.0
    t_c, m_c = _scale(e, math.radians(lat_c * pole))
    x, y = _c(x), _c(y)
    t = F.sqrt(x * x + y * y) * (t_c / (a * m_c))
    lat = math.pi / 2 - 2 * F.atan(t)
    for _ in range(rounds):
        s = e * F.sin(lat)
        lat = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return wrap_lon(F.degrees(math.radians(lon0) + F.atan2(x, y))), F.degrees(lat * pole)


def flat_distance(lon0, lat0, lon1, lat1) -> Column:
    """Metres between near points on a flat earth."""
    dx = K.EARTH_RADIUS * F.cos(F.radians((_c(lat0) + _c(lat1)) / 2)) * F.radians(_c(lon1) - _c(lon0))
    dy = K.EARTH_RADIUS * F.radians(_c(lat1) - _c(lat0))
    return F.sqrt(dx * dx + dy * dy)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def adiabatic_gradient(temp, salt, press) -> Column:
    """Degrees per decibar."""
    t, s, p = _c(temp), _c(salt) - K.ADIABATIC_SALT, _c(press)
    a = K.ADIABATIC
    return _poly(a["1"], t) + _poly(a["salt"], t) * s + (_poly(a["press"], t) + _poly(a["salt*press"], t) * s) * p + _poly(a["press*press"], t) * p * p




def with_in_situ(df, temp: str, salt: str, z: str, out: str = "temp_in_situ"):
    """``df`` with the in-situ temperature of potential temperature ``temp`` (Gill's fourth-order scheme).

    Step by step as projections of their own, so the nested expression stays small.
    """
    half, p = math.sqrt(0.5), F.abs(_c(z))
    state = df.withColumn("_t", _c(temp).cast("double")).withColumn("_q", F.lit(0.0))
    for at, gain, carry, keep in ((0.0, 0.5, 1.0, 0.0), (0.5, 1 - half, 2 - 2 * half, -2 + 3 * half), (0.5, 1 + half, 2 + 2 * half, -2 - 3 * half)):
        state = state.withColumn("_d", p * adiabatic_gradient("_t", salt, at * p))
        state = state.withColumn("_t", F.col("_t") + gain * (F.col("_d") - F.col("_q"))).withColumn("_q", carry * F.col("_d") + keep * F.col("_q"))
    state = state.withColumn("_d", p * adiabatic_gradient("_t", salt, p))
    return state.withColumn(out, F.col("_t") + (F.col("_d") - 2 * F.col("_q")) / 6).drop("_t", "_q", "_d")


def freezing_point(salt, z) -> Column:
    a, b, c = K.FREEZING
    return a * _c(salt) + b * F.abs(_c(z)) + c


def density_linear(salt, temp, rho0: float = K.RHO_SEA, t0: float = -1.0, s0: float = 34.2, alpha: float = 3.733e-5, beta: float = 7.843e-4) -> Column:
    return rho0 * (1 - alpha * (_c(temp) - t0) + beta * (_c(salt) - s0))


def density_jmd95(temp, salt, press) -> Column:
    """kg/m3 from potential temperature, salinity and pressure in dbar: density at the surface over one less pressure by bulk modulus."""
    t, s, p = _c(temp), _c(salt), _c(press) / 10  # bar
    root = s * F.sqrt(s)
    surface = _poly(K.JMD95_FRESH, t) + s * _poly(K.JMD95_SALT, t) + root * _poly(K.JMD95_SALT_ROOT, t) + s * s * K.JMD95_SALT_SQUARE
    bulk = _poly(K.JMD95_BULK_FRESH, t) + s * _poly(K.JMD95_BULK_SALT, t) + root * _poly(K.JMD95_BULK_SALT_ROOT, t)
    bulk = bulk + p * (_poly(K.JMD95_BULK_PRESS, t) + s * _poly(K.JMD95_BULK_PRESS_SALT, t) + root * K.JMD95_BULK_PRESS_SALT_ROOT)
    bulk = bulk + p * p * (_poly(K.JMD95_BULK_PRESS2, t) + s * _poly(K.JMD95_BULK_PRESS2_SALT, t))
    return surface / (1 - p / bulk)


def density_mdjwf(temp, salt, press) -> Column:
    """kg/m3 from potential temperature, salinity and pressure in dbar, as a ratio of two polynomials."""
    t, s, p = _c(temp), _c(salt), _c(press)
    total = lambda terms: sum((c * F.pow(t, F.lit(a)) * F.pow(s, F.lit(b)) * F.pow(p, F.lit(d)) for c, a, b, d in terms[1:]), F.lit(terms[0][0]))
    return total(K.MDJWF_ABOVE) / total(K.MDJWF_BELOW)


def heat_content_freezing(temp, salt, z, volume, **eos) -> Column:
    """Joules above the freezing point, with the linear equation of state."""
    return (_c(temp) - freezing_point(salt, z)) * density_linear(salt, temp, **eos) * K.HEAT_SEA * _c(volume)


def advection_above_freezing(advection, velocity, face_area, reference: float = K.FREEZING_REFERENCE) -> Column:
    return _c(advection) - reference * _c(velocity) * _c(face_area)


def shortwave_fraction(z_top, z_bottom) -> Column:
    """Share of surface short-wave flux that a layer absorbs."""
    share, first, second = K.SHORTWAVE
    left = lambda z: share * F.exp(_c(z) / first) + (1 - share) * F.exp(_c(z) / second)
    return left(z_top) - left(z_bottom)


def speed(u, v) -> Column:
    return F.hypot(_c(u), _c(v))


def angle(u, v) -> Column:
    return F.atan2(_c(v), _c(u))


def wrap_angle(a) -> Column:
    """Into (-pi, pi]."""
    a = _c(a)
    return F.when(a > math.pi, a - 2 * math.pi).when(a <= -math.pi, a + 2 * math.pi).otherwise(a)


def specific_humidity(dew_point, pressure, reference=K.KELVIN) -> Column:
    """From dew point (K) and pressure (Pa); the reference temperature may be a column."""
    e = K.SATURATION * F.exp(K.LATENT_VAPOUR / K.GAS_VAPOUR * (1 / _c(reference) - 1 / _c(dew_point)))
    return K.HUMIDITY * e / (_c(pressure) - (1 - K.HUMIDITY) * e)


def mixing_to_specific(q) -> Column:
    return _c(q) / (1 + _c(q))


def rotate(u, v, lon0: float, lat0: float, lon1: float, lat1: float, degrees_compat: bool = False) -> tuple[Column, Column]:
    """(normal, parallel) components to the line between two points.

    ``degrees_compat`` takes the degrees of the angle's arguments as radians,
    for comparison with results computed that way.
    """
    turn = (lambda d: d) if degrees_compat else math.radians
    mean = (lat0 + lat1) / 2
    a = math.atan2(turn(lat1) - turn(lat0), math.cos(turn(mean)) * (turn(lon1) - turn(lon0)))
    return _c(v) * math.cos(a) - _c(u) * math.sin(a), _c(u) * math.cos(a) + _c(v) * math.sin(a)


def sea_level(volume, first) -> Column:
    """Contribution (m) of a change of ice volume above flotation."""
    return (_c(volume) - _c(first)) * K.ICE_VOLUME_TO_SEA_LEVEL


def is_leap(year) -> Column:
    y = _c(year)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def days_in_month(year, month, leap: bool = True) -> Column:
    m, feb = _c(month), F.lit(28)
    if leap:
        feb = F.when(is_leap(year), 29).otherwise(28)
    return F.when(m == 2, feb).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(_c(x), _c(low)), _c(high))


def open_fraction(bathy, draft, z_top, z_bottom, least: float = 0.1, least_dz: float = 20.0) -> Column:
    """Open fraction of a cell between bathymetry and ice draft (all z negative down), with the minimum thickness rule.

    The wet part is what of the layer lies above the bottom and below the ice.
    """
    top, bottom, dz = _c(z_top), _c(z_bottom), F.abs(_c(z_top) - _c(z_bottom))
    raw = (F.least(top, _c(draft)) - F.greatest(bottom, _c(bathy))) / dz
    limit = F.greatest(F.lit(least), F.least(least_dz / dz, F.lit(1.0)))
    return F.when(raw < limit / 2, 0.0).when(raw < limit, limit).otherwise(raw)
