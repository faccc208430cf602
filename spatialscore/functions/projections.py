"""Coordinate transforms in closed form (P9-P12). Distances are in km, angles in degrees."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col

# Public ellipsoid and sphere constants.
SPHERE_KM = 6378.137          # radius used by the spherical Mercator projection
GRS80_A_KM = 6378.137         # GRS80 semi-major axis
GRS80_F = 1.0 / 298.257222101  # GRS80 flattening
CLARKE_A_KM = 6378.249145     # Clarke 1880 (RGS) semi-major axis
CLARKE_F = 1.0 / 293.465      # Clarke 1880 (RGS) flattening


def rotate(x, y, angle: float, cx, cy, inverse: bool = False) -> tuple[Column, Column]:
    """Centre at (cx, cy) and rotate by ``angle``; the inverse undoes it."""
    x, y, cx, cy = as_col(x), as_col(y), as_col(cx), as_col(cy)
    c, s = F.lit(math.cos(angle)), F.lit(math.sin(angle))
    if inverse:
        return c * x + s * y + cx, c * y - s * x + cy
    dx, dy = x - cx, y - cy
    return c * dx - s * dy, s * dx + c * dy


def mercator(lon, lat, inverse: bool = False) -> tuple[Column, Column]:
    """P10: spherical Mercator, forward (degrees to km) or inverse."""
    lon, lat = as_col(lon), as_col(lat)
    if inverse:
        return (
            F.degrees(lon / F.lit(SPHERE_KM)),
            F.degrees(F.lit(2.0) * F.atan(F.exp(lat / F.lit(SPHERE_KM))) - F.lit(math.pi / 2)),
        )
    return (
        F.lit(SPHERE_KM) * F.radians(lon),
        F.lit(SPHERE_KM) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2.0)),
    )


def lcc_constants(lat1: float = 33, lat2: float = 45, lat0: float = 39) -> tuple[float, float, float, float]:
    """Cone constants (e, n, F, rho0) of the ellipsoidal conic, computed once on the driver."""
    e = math.sqrt(2 * GRS80_F - GRS80_F**2)

    def m(phi):
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    def t(phi):
        es = e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (e / 2)

    p1, p2, p0 = (math.radians(v) for v in (lat1, lat2, lat0))
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    big_f = m(p1) / (n * t(p1) ** n)
    return e, n, big_f, GRS80_A_KM * big_f * t(p0) ** n


def lcc(lon, lat, lat1: float = 33, lat2: float = 45, lat0: float = 39, lon0: float = -96) -> tuple[Column, Column]:
    """Lambert conformal conic with two standard parallels on GRS80."""
    e, n, big_f, rho0 = lcc_constants(lat1, lat2, lat0)
    phi = F.radians(as_col(lat))
    es = F.lit(e) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2.0) / F.pow((F.lit(1.0) - es) / (F.lit(1.0) + es), F.lit(e / 2))
    rho = F.lit(GRS80_A_KM * big_f) * F.pow(t, F.lit(n))
    theta = F.lit(n) * F.radians(as_col(lon) - F.lit(float(lon0)))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def tmerc_constants(a: float = CLARKE_A_KM, f: float = CLARKE_F, order: int = 4):
    """Third-flattening series of the transverse Mercator (Krueger), computed on the driver."""
    n = f / (2 - f)
    rect = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # Published series coefficients to the fourth power of n.
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    return 2 * math.sqrt(n) / (1 + n), rect, alpha[:order], beta[:order], delta[:order]


def tmerc(x, y, lon0: float = 39.0, k0: float = 0.9996, east0: float = 500.0, north0: float = 10000.0,
          inverse: bool = False) -> tuple[Column, Column]:
    """Transverse Mercator of one zone, forward (lon, lat) to (east, north) in km or inverse.

    The datum shift to the national datum is left out: both sides stay on the same ellipsoid.
    """
    c, rect, alpha, beta, delta = tmerc_constants()
    x, y = as_col(x), as_col(y)
    if not inverse:
        phi, lam = F.radians(y), F.radians(x - F.lit(float(lon0)))
        sp = F.sin(phi)
        t = F.sinh(F.atanh(sp) - F.lit(c) * F.atanh(F.lit(c) * sp))
        xi = F.atan2(t, F.cos(lam))
        eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
        east, north = eta, xi
        for j, a in enumerate(alpha, start=1):
            east = east + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
            north = north + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        return F.lit(east0) + F.lit(k0 * rect) * east, F.lit(north0) + F.lit(k0 * rect) * north
    xi, eta = (y - F.lit(north0)) / F.lit(k0 * rect), (x - F.lit(east0)) / F.lit(k0 * rect)
    xp, ep = xi, eta
    for j, b in enumerate(beta, start=1):
        xp = xp - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        ep = ep - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    lat = chi
    for j, d in enumerate(delta, start=1):
        lat = lat + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    lon = F.lit(float(lon0)) + F.degrees(F.atan2(F.sinh(ep), F.cos(xp)))
    return lon, F.degrees(lat)
