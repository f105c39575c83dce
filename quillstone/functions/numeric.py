"""Scalar and array mathematics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 1_000_000_007


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, edge: float = 1e-9) -> Column:
    q = F.least(F.lit(1 - edge), F.greatest(F.lit(edge), p))
    return F.ln(q / (1 - q))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))))


def cosine(a: Column, b: Column) -> Column:
    return let(a, lambda x: let(b, lambda y: let(norm(x) * norm(y), lambda n: F.when(n > 0, dot(x, y) / n))))


def finite(x: Column) -> Column:
    """x, or null if it is no finite number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def power_mod(base: Column, exponent: Column, modulus: int = MODULUS) -> Column:
    one = F.lit(1).cast("long")
    return F.when(exponent <= 0, one).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), exponent)), one, lambda a, _: (a * base) % modulus))


def undistorted_radius(k1: Column, k2: Column, rd: Column, steps: int = 80) -> Column:
    """r with r * (1 + k1 r^2 + k2 r^4) = rd: by bisection on [0, rd], or, if no coefficient is negative, by Newton steps.

    The steps start at a bound above the root, where the curve is convex, so they fall to it.
    """
    start = F.struct(F.lit(0.0).alias("lo"), rd.alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = 0.5 * (acc["lo"] + acc["hi"])
        r2 = mid * mid
        low = mid * (1.0 + r2 * k1 + r2 * r2 * k2) < rd
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    def newton(r: Column, _: Column) -> Column:
        r2 = r * r
        return r - (r * (1.0 + r2 * (k1 + r2 * k2)) - rd) / (1.0 + r2 * (3.0 * k1 + 5.0 * r2 * k2))

    above = F.least(rd, F.when(k2 > 0, F.pow(rd / k2, F.lit(0.2))), F.when(k1 > 0, F.pow(rd / k1, F.lit(1 / 3))))
    fast = F.aggregate(F.sequence(F.lit(1), F.lit(8)), above, newton)
    return F.when((k1 >= 0) & (k2 >= 0), fast).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: 0.5 * (acc["lo"] + acc["hi"])))


def undistorted(k1: Column, k2: Column, xd: Column, yd: Column) -> tuple[Column, Column]:
    """The undistorted point; coordinates that would print as zero are zero."""
    rd = F.sqrt(xd * xd + yd * yd)
    scale = F.when(rd < 1e-15, 0.0).otherwise(undistorted_radius(k1, k2, rd) / rd)
    clean = lambda v: F.when(F.abs(v) < 5e-4, 0.0).otherwise(v)
    return clean(xd * scale), clean(yd * scale)


def kalman(values: Column, q: float, r: float, p0: float, x0: float = 0.0) -> Column:
    """array<struct<x, p, k>>: a scalar filter's states after each value."""
    start = F.struct(F.lit(x0).alias("x"), F.lit(p0).alias("p"), F.lit(None).cast("double").alias("k"))

    def step(acc: Column, z: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), start)
        ahead = last["p"] + q
        gain = ahead / (ahead + r)
        return F.concat(acc, F.array(F.struct((last["x"] + gain * (z - last["x"])).alias("x"), ((1 - gain) * ahead).alias("p"), gain.alias("k"))))

    return F.aggregate(values, F.array().cast("array<struct<x:double,p:double,k:double>>"), step)


def cross2(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Doubled signed area of a triangle."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length))).otherwise(0.0)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def angle_degrees(a: Column, b: Column) -> Column:
    """The angle between two vectors, cosine clipped."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))))
