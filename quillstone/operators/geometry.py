"""Cameras, points, clouds, hulls and images as DataFrames."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import numeric
from quillstone.sources.shared import materialize


def projected(p: list[list[float]], x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pixel coordinates under a 3x4 matrix; null behind the camera."""
    row = lambda r: r[0] * x + r[1] * y + r[2] * z + r[3]
    depth = row(p[2])
    ahead = depth > 1e-9
    return F.when(ahead, row(p[0]) / depth), F.when(ahead, row(p[1]) / depth)


def projection_matrix(k: list[list[float]], r: list[list[float]], t: list[float]) -> list[list[float]]:
    rt = [[*r[i], t[i]] for i in range(3)]
    return [[sum(k[i][m] * rt[m][j] for m in range(3)) for j in range(4)] for i in range(3)]


def world_to_camera(right: list[float], up: list[float], forward: list[float], position: list[float]) -> tuple[list[list[float]], list[float]]:
    """Rotation with rows right, -up, forward, each of unit length, and translation."""
    rows = [right, [-x for x in up], forward]
    sizes = [math.sqrt(sum(x * x for x in r)) for r in rows]
    if min(sizes) < 1e-9:
        raise ValueError("a basis vector has no length")
    rows = [[x / n for x in r] for r, n in zip(rows, sizes, strict=True)]
    return rows, [-sum(a * b for a, b in zip(r, position, strict=True)) for r in rows]


def camera_center(r: list[list[float]], t: list[float]) -> list[float]:
    return [-sum(r[i][j] * t[i] for i in range(3)) for j in range(3)]


def reprojection_error(p: list[list[float]], x: Column, y: Column, z: Column, u: Column, v: Column) -> Column:
    pu, pv = projected(p, x, y, z)
    return F.sqrt((pu - u) * (pu - u) + (pv - v) * (pv - v))


def ray_angle(a: list[float], b: list[float], x: Column, y: Column, z: Column) -> Column:
    """Degrees between the rays from two camera centres to a point."""
    to = lambda c: F.array(x - c[0], y - c[1], z - c[2])
    return numeric.angle_degrees(to(a), to(b))


def geometric_filter(points: DataFrame, pa, pb, ca, cb, least_depth: float, most_depth: float, most_error: float, least_angle: float) -> DataFrame:
    """Points (x, y, z, ua, va, ub, vb) in front of both cameras, well reprojected and seen under a wide enough angle."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    depth = lambda p: p[2][0] * x + p[2][1] * y + p[2][2] * z + p[2][3]
    inside = depth(pa).between(least_depth, most_depth) & depth(pb).between(least_depth, most_depth)
    seen = (reprojection_error(pa, x, y, z, F.col("ua"), F.col("va")) <= most_error) & (reprojection_error(pb, x, y, z, F.col("ub"), F.col("vb")) <= most_error)
    return points.where(inside & seen & (ray_angle(ca, cb, x, y, z) >= least_angle))


def confident(points: DataFrame, confidence: str, share: float = 0.2) -> DataFrame:
    """Points above an interpolated percentile of their confidence."""
    edge = points.agg(F.percentile(confidence, F.lit(share)).alias("_edge"))
    return points.join(F.broadcast(edge)).where(F.col(confidence) >= F.col("_edge")).drop("_edge")


def confident_above(points: DataFrame, confidence: str, least: float = 1.7) -> DataFrame:
    """Points above a fixed confidence."""
    return points.where(F.col(confidence) > least)


def voxels(points: DataFrame, size: float) -> DataFrame:
    """One point for each voxel: mean place, mean colour cut to an integer."""
    cell = [F.floor(F.col(a) / size).alias(f"v{a}") for a in "xyz"]
    colours = [F.avg(c).cast("int").alias(c) for c in "rgb" if c in points.columns]
    return points.groupBy(*cell).agg(*[F.avg(a).alias(a) for a in "xyz"], *colours, F.count("*").alias("n"))


def cloud_stats(points: DataFrame) -> DataFrame:
    s = [x for a in "xyz" for x in (F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), F.avg(a).alias(f"mean_{a}"), (F.max(a) - F.min(a)).alias(f"extent_{a}"))]
    return points.agg(F.count("*").alias("n"), *s)


def plane_counts(points: DataFrame, planes: DataFrame, within: float) -> DataFrame:
    """Inliers of each candidate plane (plane_id, a, b, c, d with unit normal).

    The candidates (a stated, bounded query set) meet each point as one array; only one
    count for each plane and task is shuffled.
    """
    every = planes.agg(F.collect_list(F.struct("plane_id", "a", "b", "c", "d")).alias("_p"))
    near = lambda q: F.abs(q["a"] * F.col("x") + q["b"] * F.col("y") + q["c"] * F.col("z") + q["d"]) < within
    hits = points.join(F.broadcast(every)).select(F.explode(F.transform(F.filter("_p", near), lambda q: q["plane_id"])).alias("plane_id"))
    return hits.groupBy("plane_id").agg(F.count("*").alias("inliers"))


def sampled_planes(points: DataFrame, candidates: int = 2000, seed: int = 0) -> DataFrame:
    """Planes through as many random triples of a hash-ordered sample of at most three points for each candidate (a bounded sample)."""
    spark, rng = points.sparkSession, random.Random(seed)
    few = points.select("x", "y", "z").orderBy(F.xxhash64(F.lit(seed), "x", "y", "z")).limit(3 * candidates).collect()
    rows = []
    for k in range(candidates if len(few) >= 3 else 0):
        p, q, r = rng.sample(few, 3)
        u, v = [q[i] - p[i] for i in range(3)], [r[i] - p[i] for i in range(3)]
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        size = math.sqrt(sum(x * x for x in n))
        if size > 1e-12:
            n = [x / size for x in n]
            rows.append((k, *map(float, n), float(-sum(a * b for a, b in zip(n, p, strict=True)))))
    return spark.createDataFrame(rows, "plane_id int, a double, b double, c double, d double")


def without_plane(points: DataFrame, within: float, least_share: float = 0.15, candidates: int = 2000, seed: int = 0, planes: DataFrame | None = None) -> DataFrame:
    """points without the inliers of the best plane (of the given ones, or of sampled ones), if it holds enough of them; the first of equals."""
    planes = sampled_planes(points, candidates, seed) if planes is None else planes
    best = plane_counts(points, planes, within).join(planes, "plane_id").orderBy(F.desc("inliers"), "plane_id").first()
    if best is None or best["inliers"] < least_share * points.count():
        return points
    return points.where(F.abs(best["a"] * F.col("x") + best["b"] * F.col("y") + best["c"] * F.col("z") + best["d"]) >= within)


def hull_of(points: list[tuple]) -> list[tuple]:
    """Convex hull, counter-clockwise, without points on its edges."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for run in (pts, pts[::-1]):
        chain: list[tuple] = []
        for p in run:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return chains[0] + chains[1]


def convex_hull(points: DataFrame) -> DataFrame:
    """Hull vertices in order (pos, x, y): hulls of the partitions first, then the hull of these.

    What meets in one task are hull vertices only, a few for each partition.
    """
    import pandas as pd

    def part(batches: Iterator) -> Iterator:
        held: list[tuple] = []
        for b in batches:
            held = hull_of(held + list(zip(b["x"].tolist(), b["y"].tolist(), strict=True)))
        if held:
            yield pd.DataFrame(held, columns=["x", "y"])

    def last(group: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(list(zip(group["x"].tolist(), group["y"].tolist(), strict=True)))
        return pd.DataFrame({"pos": range(len(h)), "x": [p[0] for p in h], "y": [p[1] for p in h]})

    kind = dict(points.dtypes)["x"]
    parts = points.select("x", "y").mapInPandas(part, f"x {kind}, y {kind}")
    return parts.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(last, f"pos int, x {kind}, y {kind}")


def largest_triangle(points: DataFrame) -> DataFrame:
    """Doubled area of the largest triangle, over hull vertices only."""
    h = convex_hull(points).agg(F.collect_list(F.struct("x", "y")).alias("h"))
    corner = lambda i, j, k: F.abs(numeric.cross2(i["x"], i["y"], j["x"], j["y"], k["x"], k["y"]))
    best = lambda i: F.aggregate("h", F.lit(0).cast("long"), lambda a, j: F.greatest(a, F.aggregate("h", F.lit(0).cast("long"), lambda b, k: F.greatest(b, corner(i, j, k).cast("long")))))
    return h.select(F.explode("h").alias("i"), "h").repartition(F.col("i")).select(best(F.col("i")).alias("a")).agg(F.coalesce(F.max("a"), F.lit(0)).cast("long").alias("doubled_area"))


def polygon(points: DataFrame, key: str) -> DataFrame:
    """Area and perimeter of polygons (key, pos, x, y)."""
    w = Window.partitionBy(key).orderBy("pos")
    ends = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(ends)) for c in ("x", "y"))
    held = points.select(key, "x", "y", nx.alias("nx"), ny.alias("ny"))
    return held.groupBy(key).agg((F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"), F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("perimeter"))


def blurred(grid: DataFrame, reach: int, base: int, modulus: int = numeric.MODULUS) -> DataFrame:
    """Weighted window sums modulo a prime: weight base^|d| along both axes, outside counts 0.

    Separable: two passes; in each a cell is sent to the 2 * reach + 1 cells around it
    and summed there, with the modulus taken of each term and each partial sum.
    """
    powers = [pow(base, d, modulus) for d in range(reach + 1)]
    size = grid.agg(F.max("i").alias("mi"), F.max("j").alias("mj"))

    def one(df: DataFrame, axis: str, last: str) -> DataFrame:
        d = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
        sent = df.join(F.broadcast(size)).withColumn("d", d).withColumn(axis, F.col(axis) + F.col("d")).where((F.col(axis) >= 0) & (F.col(axis) <= F.col(last)))
        weight = F.get(F.lit(powers).cast("array<bigint>"), F.abs("d"))
        return sent.groupBy("i", "j").agg((F.sum((F.col("v") % modulus) * weight % modulus) % modulus).alias("v"))

    return one(one(grid.select("i", "j", F.col("v").cast("long").alias("v")), "j", "mj"), "i", "mi")


def bright_components(pixels: DataFrame, thresholds=tuple(range(250, 49, -20))) -> DataFrame:
    """threshold, component (its least pixel), size and mean of the 8-connected bright regions of an image (i, j, v)."""
    from quillstone.operators.neighbours import components

    width = pixels.agg(F.max("j")).first()[0] + 1
    levels = F.explode(F.filter(F.lit(list(thresholds)), lambda t: t <= F.col("v")))
    lit = pixels.select("i", "j", "v", levels.alias("t")).withColumn("node", F.shiftleft(F.col("t").cast("long"), 40) + F.col("i") * width + F.col("j"))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    sent = lit.select("t", "node", "i", "j", moves.alias("m")).select("t", F.col("node").alias("a"), (F.col("i") + F.col("m.a")).alias("i"), (F.col("j") + F.col("m.b")).alias("j"))
    edges = sent.join(lit.select("t", "i", "j", F.col("node").alias("b")), ["t", "i", "j"]).select("a", "b")
    named = lit.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return named.groupBy("t", "component").agg(F.count("*").alias("size"), F.avg("v").alias("mean"), F.sort_array(F.collect_list(F.struct("j", "i"))).alias("cells")).withColumnRenamed("t", "threshold")


def quad_of(hull: list[tuple]) -> list[tuple]:
    """Four corners: the vertex with the smallest triangle goes until four are left."""
    h = list(hull)
    area = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    while len(h) > 4:
        k = min(range(len(h)), key=lambda i: (area(h[i - 1], h[i], h[(i + 1) % len(h)]), i))
        h.pop(k)
    return h


def square_score(cells: list[tuple], mean: float) -> tuple[float, list[tuple]] | None:
    """How square a region is, and its corners; None if it is no candidate.

    Fixed values: 10 cells, area 5, leniency 0.15 for the fill, 0.05 for the corners,
    0.5 for the edges, decay 5.
    """
    if len(cells) < 10:
        return None
    h = hull_of(cells)
    if len(h) < 4:
        return None
    ring = lambda p: list(zip(p, p[1:] + p[:1], strict=True))
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in ring(p))) / 2
    length = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    whole = area(h)
    if whole < 5:
        return None
    fill = len(cells) / (whole + sum(length(a, b) for a, b in ring(h)) / 2 + 1)
    q = quad_of(h)

    def off(p: tuple, a: tuple, b: tuple) -> float:
        n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / n)) if n else 0.0
        return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))

    stray = sum(min(off(p, a, b) for a, b in ring(q)) for p in h) / len(h)
    sides = [length(a, b) for a, b in ring(q)]
    score = mean * math.exp(-5 * max(0.0, abs(1 - fill) - 0.15)) * math.exp(-5 * max(0.0, 0.95 - area(q) / whole)) * math.exp(-max(0.0, stray - 0.5))
    return score * (min(sides) / max(sides) if max(sides) > 1e-9 else 0.0) * math.log10(max(10.0, area(q))), q


def find_square(pixels: DataFrame) -> DataFrame:
    """row and col of the four corners of the squarest bright region; each region is scored in its own row."""
    import pandas as pd

    size = pixels.agg(F.max("i").alias("m"), F.max("j").alias("n")).first()

    def score(batches: Iterator) -> Iterator:
        for b in batches:
            out = []
            for t, c, mean, cells in zip(b["threshold"], b["component"], b["mean"], b["cells"], strict=True):
                found = square_score([(x["j"], x["i"]) for x in cells], mean)
                if found:
                    out.append((int(t), int(c), found[0], [[float(x), float(y)] for x, y in found[1]]))
            yield pd.DataFrame(out, columns=["threshold", "component", "score", "corners"])

    scored = bright_components(pixels).mapInPandas(score, "threshold int, component long, score double, corners array<array<double>>")
    best = scored.agg(F.max_by("corners", F.struct("score", "threshold", (-F.col("component")).alias("c"))).alias("c")).select(F.explode("c").alias("p"))
    clamp = lambda v, m: F.least(F.lit(m), F.greatest(F.lit(0), F.round(v).cast("int")))
    return best.select(clamp(F.get("p", F.lit(1)), size["m"]).alias("row"), clamp(F.get("p", F.lit(0)), size["n"]).alias("col"))


def pixel_colours(points: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """points (u, v) with the colour of their nearest pixel, halves to even."""
    place = lambda c, m: F.least(F.lit(m - 1), F.greatest(F.lit(0), F.bround(c).cast("int")))
    return points.withColumns({"j": place(F.col("u"), width), "i": place(F.col("v"), height)}).join(pixels, ["i", "j"]).drop("i", "j")


def _null_vector(rows):
    import numpy as np

    return np.linalg.svd(np.asarray(rows))[2][-1]


def fundamental_inliers(matches: DataFrame, key: str = "pair", threshold: float = 2.0, tries: int = 500, seed: int = 0) -> DataFrame:
    """Matches (pair, ua, va, ub, vb) of each image pair that agree with its best fundamental matrix; pairs under eight matches go."""
    import numpy as np
    import pandas as pd

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) < 8:
            return group.head(0)
        a, b = (np.column_stack([group[f"u{s}"], group[f"v{s}"], np.ones(len(group))]) for s in "ab")

        def normal(p):
            m, s = p[:, :2].mean(0), max(p[:, :2].std(), 1e-9)
            t = np.array([[1 / s, 0, -m[0] / s], [0, 1 / s, -m[1] / s], [0, 0, 1]])
            return p @ t.T, t

        (an, ta), (bn, tb) = normal(a), normal(b)
        rng, best = np.random.default_rng(seed), np.zeros(len(group), bool)
        for _ in range(tries):
            pick = rng.choice(len(group), 8, replace=False)
            f = _null_vector(np.einsum("ni,nj->nij", bn[pick], an[pick]).reshape(-1, 9)).reshape(3, 3)
            u, s, v = np.linalg.svd(f)
            f = tb.T @ (u @ np.diag([s[0], s[1], 0]) @ v) @ ta
            la, lb = a @ f.T, b @ f
            e = np.abs(np.einsum("ni,ni->n", b, la))
            far = np.maximum(e / np.maximum(np.hypot(la[:, 0], la[:, 1]), 1e-12), e / np.maximum(np.hypot(lb[:, 0], lb[:, 1]), 1e-12))
            if (far < threshold).sum() > best.sum():
                best = far < threshold
        return group[best]

    return matches.groupBy(key).applyInPandas(fit, matches.schema)


def smallest_vectors(normal):
    """The eigenvector of the smallest eigenvalue of each of many symmetric matrices."""
    import numpy as np

    return np.linalg.eigh(normal)[1][..., 0]


def triangulated(views: DataFrame, matrices: dict[int, list[list[float]]], key: str = "track") -> DataFrame:
    """x, y, z of each track from its views (track, image, u, v) by direct linear transform, its largest reprojection error and its least and greatest depth.

    The two equations of each view add up to a symmetric 4 x 4 matrix for each track, by one
    aggregation; the null vectors of a whole Arrow batch of tracks are found at once; errors
    and depths are an aggregation of the views again.  Tracks of one view go, and views of
    images without a matrix.
    """
    import numpy as np

    spark = views.sparkSession
    cameras = spark.createDataFrame([(int(k), [float(x) for row in m for x in row]) for k, m in matrices.items()], "image long, _m array<double>")
    seen = views.select(key, F.col("image").cast("long").alias("image"), "u", "v").join(F.broadcast(cameras), "image")
    m = lambda i, j: F.get("_m", F.lit(4 * i + j))
    one, two = [F.col("u") * m(2, j) - m(0, j) for j in range(4)], [F.col("v") * m(2, j) - m(1, j) for j in range(4)]
    half = [(i, j) for i in range(4) for j in range(i, 4)]
    normal = seen.groupBy(key).agg(F.count("*").cast("int").alias("n_views"), *[F.sum(one[i] * one[j] + two[i] * two[j]).alias(f"_s{i}{j}") for i, j in half])

    def solve(batches: Iterator) -> Iterator:
        for b in batches:
            a = np.empty((b.num_rows, 4, 4))
            for i, j in half:
                a[:, i, j] = a[:, j, i] = b.column(f"_s{i}{j}").to_numpy(zero_copy_only=False)
            h = smallest_vectors(a)
            good = np.flatnonzero(np.abs(h[:, 3]) >= 1e-12)
            x = h[good, :3] / h[good, 3:]
            at = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(key).take(at), *[pa.array(x[:, k]) for k in range(3)], b.column("n_views").take(at)], names=[key, "x", "y", "z", "n_views"])

    found = normal.where("n_views >= 2").mapInArrow(solve, f"{key} {dict(views.dtypes)[key]}, x double, y double, z double, n_views int")
    q = [m(i, 0) * F.col("x") + m(i, 1) * F.col("y") + m(i, 2) * F.col("z") + m(i, 3) for i in range(3)]
    error = F.when(q[2] > 1e-9, F.hypot(q[0] / q[2] - F.col("u"), q[1] / q[2] - F.col("v"))).otherwise(float("inf"))
    back = seen.join(found, key).select(key, "x", "y", "z", "n_views", error.alias("_e"), q[2].alias("_d"))
    return back.groupBy(key).agg(*[F.first(c).alias(c) for c in ("x", "y", "z", "n_views")], F.max("_e").alias("worst"), F.min("_d").alias("near"), F.max("_d").alias("far"))


def promoted_tracks(links: DataFrame, keypoints: DataFrame, matrices: dict[int, list[list[float]]], least_views: int = 3, most_error: float = 6.0) -> DataFrame:
    """Tracks of linked keypoints (a, b: node ids; node, image, u, v) with enough views and small errors; one keypoint for each image, the first."""
    from quillstone.operators.neighbours import components

    named = keypoints.join(components(links), "node")
    first = named.groupBy("component", "image").agg(F.min_by(F.struct("u", "v"), "node").alias("p")).select(F.col("component").alias("track"), "image", "p.*")
    enough = first.groupBy("track").agg(F.count("*").alias("n")).where(F.col("n") >= least_views)
    return triangulated(first.join(enough, "track", "left_semi"), matrices).where(F.col("worst") <= most_error)


DEPTH_DIGITS = 6


def track_cloud(matches: DataFrame, keypoints: DataFrame, matrices: dict[int, list[list[float]]], near: float, far: float, least_views: int = 3, most_error: float = 6.0, threshold: float = 2.0, tries: int = 500) -> DataFrame:
    """The sparse cloud of matched keypoints (pair, a, b, ua, va, ub, vb): matches that no fundamental matrix explains go, the
    rest are linked to tracks, and tracks with enough views, small errors and depths within bounds become points.  Depths
    are rounded to DEPTH_DIGITS, so that a point on a bound is not left to the noise of the triangulation."""
    good = materialize(fundamental_inliers(matches, threshold=threshold, tries=tries), "matches")
    return promoted_tracks(good.select("a", "b"), keypoints, matrices, least_views, most_error).where((F.round("near", DEPTH_DIGITS) >= near) & (F.round("far", DEPTH_DIGITS) <= far))


def pose_check(poses: DataFrame, k: list[list[float]], ahead: float = 100.0, aside: float = 25.0) -> DataFrame:
    """index and whether three probe points land where a camera should see them.

    A point straight ahead within 5 pixels of the centre; one to the right more than 50 to
    the right of it; one up more than 50 above it.
    """

    def seen(right: float, up: float) -> tuple[Column, Column]:
        d = [F.zip_with(F.transform("forward", lambda f: f * ahead), F.zip_with("right", "up", lambda r, u: r * right + u * up), lambda a, b: a + b)]
        dot = lambda v: numeric.dot(d[0], F.col(v))
        return k[0][2] + k[0][0] * dot("right") / dot("forward"), k[1][2] - k[1][1] * dot("up") / dot("forward")

    (cx, cy), (rx, _), (_, uy) = seen(0, 0), seen(aside, 0), seen(0, aside)
    ok = (F.hypot(cx - k[0][2], cy - k[1][2]) <= 5) & (rx > cx + 50) & (uy < cy - 50)
    return poses.select("index", ok.alias("ok"))
