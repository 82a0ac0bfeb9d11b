"""WGS 84 to UTM metres and back by Krueger's series (Karney 2011), as column expressions and as SQL text."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_F = 1 / 298.257223563
_N = _F / (2 - _F)
#: Scale times rectifying radius; central meridian of zone 43; false easting.
SCALE = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
MERIDIAN, EASTING = 75.0, 500000.0
_E = 2 * math.sqrt(_N) / (1 + _N)
ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]


def to_utm_sql(lat: str, lon: str) -> tuple[str, str]:
    """Easting and northing as expressions that Spark and DuckDB share."""
    t = f"sinh(atanh(sin(radians({lat}))) - {_E!r}*atanh({_E!r}*sin(radians({lat}))))"
    d = f"radians({lon}-{MERIDIAN!r})"
    xi, eta = f"atan2({t}, cos({d}))", f"asinh(sin({d})/sqrt({t}*{t}+cos({d})*cos({d})))"
    x = " + ".join([eta, *(f"{a!r}*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, a in enumerate(ALPHA, 1))])
    y = " + ".join([xi, *(f"{a!r}*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, a in enumerate(ALPHA, 1))])
    return f"({EASTING!r} + {SCALE!r}*({x}))", f"({SCALE!r}*({y}))"


def to_latlon_sql(x: str, y: str) -> tuple[str, str]:
    xi, eta = f"({y}/{SCALE!r})", f"(({x}-{EASTING!r})/{SCALE!r})"
    a = "(" + " - ".join([xi, *(f"{b!r}*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, b in enumerate(BETA, 1))]) + ")"
    b = "(" + " - ".join([eta, *(f"{b!r}*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, b in enumerate(BETA, 1))]) + ")"
    chi = f"asin(sin({a})/cosh({b}))"
    lat = " + ".join([chi, *(f"{d!r}*sin({2 * j}*{chi})" for j, d in enumerate(DELTA, 1))])
    return f"degrees({lat})", f"({MERIDIAN!r} + degrees(atan2(sinh({b}), cos({a}))))"


def to_utm(lat: str, lon: str) -> tuple[Column, Column]:
    """Easting and northing in metres of two columns in degrees; null for null."""
    x, y = to_utm_sql(lat, lon)
    return F.expr(x.replace("e-", "E-")), F.expr(y.replace("e-", "E-"))


def to_latlon(x: str, y: str) -> tuple[Column, Column]:
    a, b = to_latlon_sql(x, y)
    return F.expr(a.replace("e-", "E-")), F.expr(b.replace("e-", "E-"))


def utm_of(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing of arrays in degrees."""
    s = np.sin(np.radians(lat))
    t, d = np.sinh(np.arctanh(s) - _E * np.arctanh(_E * s)), np.radians(lon - MERIDIAN)
    xi, eta = np.arctan2(t, np.cos(d)), np.arcsinh(np.sin(d) / np.sqrt(t * t + np.cos(d) ** 2))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return EASTING + SCALE * x, SCALE * y


def latlon_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude in degrees of arrays in metres."""
    xi, eta = y / SCALE, (x - EASTING) / SCALE
    a = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
    b = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
    chi = np.arcsin(np.sin(a) / np.cosh(b))
    return np.degrees(chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))), MERIDIAN + np.degrees(np.arctan2(np.sinh(b), np.cos(a)))
