"""Closed-form engineering relations as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def euler_load(e: Column, i: Column, length: Column, support: Column) -> Column:
    """Critical load of a column held at `support` from one end."""
    span = F.greatest(support, length - support)
    return math.pi**2 * e * i / (span * span)


def cell_current(v: Column, isc: float, voc: float, vt: float) -> Column:
    return isc * (1 - F.exp((v - voc) / vt))


def mohr(sx: Column, sy: Column, txy: Column) -> tuple[Column, Column, Column]:
    """Radius and the two principal stresses."""
    c, r = (sx + sy) / 2, F.sqrt(((sx - sy) / 2) * ((sx - sy) / 2) + txy * txy)
    return r, c + r, c - r


def rescaled_frequency(f: Column, target: Column, band: Column) -> Column:
    return f * target / band


def counterflow_effectiveness(ntu: Column, ratio: Column) -> Column:
    x = F.exp(-ntu * (1 - ratio))
    return F.when(F.abs(1 - ratio) < 1e-12, ntu / (1 + ntu)).otherwise((1 - x) / (1 - ratio * x))


def carnot(t_low: Column, t_high: Column) -> Column:
    return 1 - t_low / t_high


def torsion_torque(tau: Column, radius: Column) -> Column:
    """Torque of a solid shaft: tau * J / R with J = pi R^4 / 2."""
    return tau * math.pi * F.pow(radius, F.lit(3.0)) / 2


def resonance(inductance: Column, capacity: Column) -> Column:
    return 1 / (2 * math.pi * F.sqrt(inductance * capacity))


def mach_area(mach: Column, gamma: float = 1.4) -> Column:
    """A / A* of an isentropic flow."""
    t = (2 / (gamma + 1)) * (1 + (gamma - 1) / 2 * mach * mach)
    return F.pow(t, F.lit((gamma + 1) / (2 * (gamma - 1)))) / mach


def mach_after_shock(mach: Column, gamma: float = 1.4) -> Column:
    return F.sqrt((1 + (gamma - 1) / 2 * mach * mach) / (gamma * mach * mach - (gamma - 1) / 2))


def shock_pressure_ratio(mach: Column, gamma: float = 1.4) -> Column:
    return 1 + 2 * gamma / (gamma + 1) * (mach * mach - 1)


def planar_arm(a: tuple[Column, Column, Column], lengths: tuple[float, float, float]) -> tuple[Column, Column]:
    """End point of three joints with relative angles in radians."""
    s1, s2, s3 = a[0], a[0] + a[1], a[0] + a[1] + a[2]
    return sum((length * F.cos(s) for length, s in zip(lengths, (s1, s2, s3), strict=True)), F.lit(0.0)), sum((length * F.sin(s) for length, s in zip(lengths, (s1, s2, s3), strict=True)), F.lit(0.0))


def pid(error: Column, integral: Column, slope: Column, kp: float, ki: float, kd: float) -> Column:
    return kp * error + ki * integral + kd * slope


def quadratic_cost(x: Column, u: Column, q: float, r: float) -> Column:
    return q * x * x + r * u * u


def planar_arm_angles(x: Column, y: Column, heading: Column, lengths: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """Joint angles (radians, elbow down) that reach a point with a heading; null beyond reach."""
    wx, wy = x - lengths[2] * F.cos(heading), y - lengths[2] * F.sin(heading)
    c2 = (wx * wx + wy * wy - lengths[0] ** 2 - lengths[1] ** 2) / (2 * lengths[0] * lengths[1])
    a2 = F.when(F.abs(c2) <= 1, F.acos(c2))
    a1 = F.atan2(wy, wx) - F.atan2(lengths[1] * F.sin(a2), lengths[0] + lengths[1] * F.cos(a2))
    return a1, a2, heading - a1 - a2


def elbow_determinant(a2: Column, l1: float, l2: float) -> Column:
    """Determinant of a two-link Jacobian."""
    return l1 * l2 * F.sin(a2)


def counterflow_outlet(hot_in: Column, cold_in: Column, effectiveness: Column, ratio_hot: Column) -> Column:
    """Outlet of the hot stream; ratio_hot is C_min / C_hot."""
    return hot_in - effectiveness * ratio_hot * (hot_in - cold_in)
