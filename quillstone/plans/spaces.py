"""Vector, neighbour, geometry, signal, parser, engineering, streaming and model queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import engineering as E, numeric as N, text as T
from quillstone.operators import comments, geometry as G, models, neighbours as K, parsers as P, relational as R, sequences as Q, signal as S
from quillstone.plans import texts
from quillstone.plans.registry import listed, query, sql_values, table
from quillstone.streaming import rates

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id, round(max({_COS}), 6) AS max_cosine, round(avg(({_COS} > 0.5)::INT), 6) AS share_above FROM embeddings a, embeddings b WHERE a.label <> 0 AND b.label = 0 GROUP BY a.vec_id")
def q_template_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return comments.template_similarity(e.where("label <> 0"), e.where("label = 0")).select("vec_id", *texts.r6("max_cosine", "share_above"))


@query(f"WITH m AS (SELECT a.vec_id, a.label, max({_COS}) AS s FROM embeddings a, embeddings b WHERE a.label <> 0 AND b.label = 0 GROUP BY ALL) SELECT label, round(max(s), 6) AS max_sim, round(avg(s), 6) AS mean_sim, round(avg((s > 0.75)::INT), 6) AS share_high FROM m GROUP BY label")
def q_conv_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    s = comments.template_similarity(e.where("label <> 0"), e.where("label = 0")).join(e.select("vec_id", "label"), "vec_id")
    return s.groupBy("label").agg(F.round(F.max("max_cosine"), 6).alias("max_sim"), F.round(F.avg("max_cosine"), 6).alias("mean_sim"), F.round(F.avg((F.col("max_cosine") > 0.75).cast("int")), 6).alias("share_high"))


@query("""WITH d AS (SELECT a.vec_id AS query, b.vec_id AS target, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))) AS d FROM embeddings a, embeddings b WHERE a.label % 2 = 1 AND b.label % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, target) AS r, lead(d) OVER (PARTITION BY query ORDER BY d, target) AS d2 FROM d) SELECT query, target, round(d, 6) AS distance FROM r WHERE r = 1 AND d < 0.97 * d2""")
def q_knn_ratio(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.two_nearest(e.where("label % 2 = 1"), e.where("label % 2 = 0"), "vec_id", "embedding", 0.97).select("query", "target", *texts.r6("distance"))


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON b.n_nationkey > a.n_nationkey AND b.n_nationkey <= a.n_nationkey + 3")
def q_band_pairs(spark, sf_dir):
    return K.band_pairs(table(spark, sf_dir, "nation"), "n_nationkey", 3)


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def q_ordered_pairs(spark, sf_dir):
    return K.ordered_pairs(table(spark, sf_dir, "nation"), "n_nationkey")


_PTS = "pts AS (SELECT p_partkey AS id, (p_partkey * 37 % 101) / 10.0 AS x, (p_size * 13 % 29) / 5.0 AS y, round((p_partkey * 7919 % 1009) / 100.0, 3) AS z FROM part)"


def cloud(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("id"), (k * 37 % 101 / 10.0).alias("x"), (s * 13 % 29 / 5.0).alias("y"), F.round(k * 7919 % 1009 / 100.0, 3).alias("z"))


@query(f"WITH {_PTS} SELECT a.id, count(*) AS neighbours FROM pts a JOIN pts b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.81 GROUP BY a.id HAVING count(*) >= 5")
def q_radius_outliers(spark, sf_dir):
    return K.radius_counts(cloud(spark, sf_dir), 0.9).where("neighbours >= 5")


@query(f"""WITH {_PTS}, d AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, b.id) AS r FROM pts a JOIN pts b ON a.id <> b.id),
m AS (SELECT id, avg(d) AS m FROM d WHERE r <= 5 GROUP BY id) SELECT id, round(m, 5) AS mean_distance FROM m WHERE m <= (SELECT avg(m) + 2 * stddev_pop(m) FROM m)""")
def q_statistical_outliers(spark, sf_dir):
    return K.statistical_inliers(K.nearest_distances(cloud(spark, sf_dir), 5)).select("id", F.round("mean_distance", 5).alias("mean_distance"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, floor(s_suppkey * s_suppkey / 7 % 61)::BIGINT AS b FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT a AS node FROM u),
r(node, c) AS (SELECT node, node FROM n UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.c) SELECT node, min(c) AS component FROM r GROUP BY node""")
def q_components(spark, sf_dir):
    return K.components(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.floor(F.col("s_suppkey") * F.col("s_suppkey") / 7 % 61).alias("b")))


@query("""SELECT floor(l_quantity / 5)::BIGINT AS vx, floor(l_discount / 0.02)::BIGINT AS vy, floor(l_extendedprice / 20000)::BIGINT AS vz, round(avg(l_quantity), 5) AS x, round(avg(l_discount), 5) AS y, round(avg(l_extendedprice), 1) AS z, avg(l_linenumber)::DOUBLE::INT AS dummy, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3""".replace(" avg(l_linenumber)::DOUBLE::INT AS dummy,", " floor(avg(l_linenumber))::INT AS r,"))
def q_voxel(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 5).alias("x"), (F.col("l_discount") / 0.02).alias("y"), (F.col("l_extendedprice") / 20000).alias("z"), F.col("l_linenumber").alias("r"))
    return G.voxels(p, 1.0).select("vx", "vy", "vz", F.round(F.col("x") * 5, 5).alias("x"), F.round(F.col("y") * 0.02, 5).alias("y"), F.round(F.col("z") * 20000, 1).alias("z"), "r", "n")


@query(f"WITH {_PTS} SELECT count(*) AS n, " + ", ".join(f"round(min({a}), 6) AS min_{a}, round(max({a}), 6) AS max_{a}, round(avg({a}), 6) AS mean_{a}, round(max({a}) - min({a}), 6) AS extent_{a}" for a in "xyz") + " FROM pts")
def q_cloud_stats(spark, sf_dir):
    s = G.cloud_stats(cloud(spark, sf_dir))
    return s.select("n", *texts.r6(*[c for c in s.columns if c != "n"]))


_K3 = [[800.0, 0.0, 320.0], [0.0, 800.0, 240.0], [0.0, 0.0, 1.0]]
_RA, _TA = G.world_to_camera([1, 0, 0], [0, -1, 0], [0, 0, 1], [5, 3, -10])
_RB, _TB = G.world_to_camera([1, 0, 0], [0, -1, 0], [0, 0, 1], [7, 3, -10])
_PA, _PB = G.projection_matrix(_K3, _RA, _TA), G.projection_matrix(_K3, _RB, _TB)


@query(f"WITH {_PTS} SELECT id, round(320 + 800 * (x - 5) / (z + 10), 5) AS u, round(240 + 800 * (y - 3) / (z + 10), 5) AS v FROM pts")
def q_project(spark, sf_dir):
    u, v = G.projected(_PA, F.col("x"), F.col("y"), F.col("z"))
    return cloud(spark, sf_dir).select("id", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


@query(f"""WITH {_PTS} SELECT id FROM pts WHERE z + 10 BETWEEN 2 AND 18 AND degrees(acos(greatest(-1, least(1, ((x - 5) * (x - 7) + (y - 3) ** 2 + (z + 10) ** 2) / (sqrt((x - 5) ** 2 + (y - 3) ** 2 + (z + 10) ** 2) * sqrt((x - 7) ** 2 + (y - 3) ** 2 + (z + 10) ** 2)))))) >= 7""")
def q_geometric_filter(spark, sf_dir):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    (ua, va), (ub, vb) = G.projected(_PA, x, y, z), G.projected(_PB, x, y, z)
    seen = cloud(spark, sf_dir).withColumns({"ua": ua + 0.5, "va": va, "ub": ub, "vb": vb - 0.5})
    return G.geometric_filter(seen, _PA, _PB, G.camera_center(_RA, _TA), G.camera_center(_RB, _TB), 2.0, 18.0, 1.0, 7.0).select("id")


_SHOTS = {k: G.projection_matrix(_K3, *G.world_to_camera([1, 0, 0], [0, -1, 0], [0, 0, 1], at)) for k, at in enumerate(([5, 3, -10], [7, 3.5, -10], [3.5, 4, -11]))}


@query(f"WITH {_PTS} SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, 3 AS n_views FROM pts WHERE z + 11 <= 20")
def q_track_cloud(spark, sf_dir):
    """Points seen by three cameras, with a tenth of false matches among false keypoints, found again; what of the false ones agrees by chance has negative ids."""
    pts = cloud(spark, sf_dir)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    views = [pts.select("id", F.lit(k).alias("image"), *[c.alias(n) for c, n in zip(G.projected(m, x, y, z), "uv", strict=True)]) for k, m in _SHOTS.items()]
    seen = views[0].unionByName(views[1]).unionByName(views[2])
    false = seen.where("id % 10 = 0").withColumns({"id": -F.col("id") - 1, "u": F.col("u") + 90, "v": F.col("v") - 70})
    keypoints = seen.unionByName(false).select((F.col("id") * 10 + F.col("image")).cast("long").alias("node"), "id", "image", "u", "v")
    side = lambda s: keypoints.select(F.col("id").alias("k"), F.col("node").alias(s), F.col("image").alias(f"i{s}"), F.col("u").alias(f"u{s}"), F.col("v").alias(f"v{s}"))
    pairs = side("a").join(side("b"), "k").where("ia < ib")
    matches = pairs.select((F.col("ia") * 3 + F.col("ib")).alias("pair"), "a", "b", "ua", "va", "ub", "vb")
    found = G.track_cloud(matches, keypoints.select("node", "image", "u", "v"), _SHOTS, 2.0, 20.0)
    return found.where("track >= 0").select(F.floor(F.col("track") / 10).alias("id"), *[F.round(a, 3).alias(a) for a in "xyz"], "n_views")


_PLANES = [(0, 1.0, 0.0, 0.0, -5.0), (1, 0.0, 0.6, 0.8, -4.0), (2, 0.0, 0.0, 1.0, -2.0)]


@query(f"WITH {_PTS}, pl(plane_id, a, b, c, d) AS (VALUES {sql_values(_PLANES)}) SELECT plane_id, count(*) AS inliers FROM pts, pl WHERE abs(a * x + b * y + c * z + d) < 0.333 GROUP BY 1")
def q_plane_consensus(spark, sf_dir):
    return G.plane_counts(cloud(spark, sf_dir), listed(spark, _PLANES, "plane_id int, a double, b double, c double, d double"), 0.333)


@query(f"""WITH {_PTS}, pl(plane_id, a, b, c, d) AS (VALUES {sql_values(_PLANES)}), n AS (SELECT plane_id, a, b, c, d, count(*) AS inliers FROM pts, pl WHERE abs(a * x + b * y + c * z + d) < 0.333 GROUP BY ALL),
best AS (SELECT * FROM n WHERE inliers >= 0.05 * (SELECT count(*) FROM pts) ORDER BY inliers DESC, plane_id LIMIT 1) SELECT id FROM pts WHERE NOT EXISTS (SELECT 1 FROM best WHERE abs(a * x + b * y + c * z + d) < 0.333)""")
def q_plane_removal(spark, sf_dir):
    planes = listed(spark, _PLANES, "plane_id int, a double, b double, c double, d double")
    return G.without_plane(cloud(spark, sf_dir), 0.333, 0.05, planes=planes).select("id")


@query()
def q_plane_removal_sampled(spark, sf_dir):
    return G.without_plane(cloud(spark, sf_dir), 0.3, 0.05, 200).select("id")


@query("""WITH p AS (SELECT DISTINCT p_size * p_size % 83 AS x, p_size * 31 % 59 AS y FROM part) SELECT max(abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)))::BIGINT AS doubled_area FROM p a, p b, p c""")
def q_max_triangle(spark, sf_dir):
    s = F.col("p_size").cast("long")
    return G.largest_triangle(table(spark, sf_dir, "part").select((s * s % 83).alias("x"), (s * 31 % 59).alias("y")))


@query("""WITH p AS (SELECT r_regionkey AS k, generate_series AS pos, round((r_regionkey + 1) * cos(generate_series * 1.0471975511965976), 6) AS x, round((r_regionkey + 2) * sin(generate_series * 1.0471975511965976), 6) AS y FROM region, generate_series(0, 5)),
q AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w2) AS nx, coalesce(lead(y) OVER w, first(y) OVER w2) AS ny FROM p WINDOW w AS (PARTITION BY k ORDER BY pos), w2 AS (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT k, round(abs(sum(x * ny - nx * y)) / 2, 4) AS area, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 4) AS perimeter FROM q GROUP BY k""")
def q_polygon(spark, sf_dir):
    k, pos = F.col("k"), F.col("pos")
    p = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    p = p.select("k", "pos", F.round((k + 1) * F.cos(pos * (math.pi / 3)), 6).alias("x"), F.round((k + 2) * F.sin(pos * (math.pi / 3)), 6).alias("y"))
    return G.polygon(p, "k").select("k", F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"))


_GRID = "g AS (SELECT day(ts)::INT - 1 AS i, hour(ts)::INT AS j, sum(event_id * 1000003)::BIGINT AS v FROM events GROUP BY 1, 2)"


def grid(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.dayofmonth("ts") - 1).alias("i"), F.hour("ts").alias("j")).agg(F.sum(F.col("event_id") * 1000003).alias("v"))


@query(f"""WITH {_GRID}, c AS (SELECT DISTINCT a.i, b.j FROM g a, g b),
r AS (SELECT c.i, c.j, sum((g.v % 1000000007) * (3 ** abs(g.j - c.j))::BIGINT % 1000000007)::BIGINT % 1000000007 AS v FROM c JOIN g ON g.i = c.i AND abs(g.j - c.j) <= 2 GROUP BY ALL)
SELECT c.i, c.j, (sum((r.v % 1000000007) * (3 ** abs(r.i - c.i))::BIGINT % 1000000007) % 1000000007)::BIGINT AS v FROM c JOIN r ON r.j = c.j AND abs(r.i - c.i) <= 2 GROUP BY ALL""")
def q_blur_mod(spark, sf_dir):
    return G.blurred(grid(spark, sf_dir), 2, 3)


_R = "list_reduce([d]::DOUBLE[] || list_transform(range(60), lambda i: d), lambda r, w: r - (r * (1 + 0.1 * r * r + 0.01 * r ** 4) - w) / (1 + 0.3 * r * r + 0.05 * r ** 4))"


@query(f"""WITH e AS (SELECT event_id, value / 500 - 0.05 AS x, event_id % 17 / 100 - 0.05 AS y FROM events), s AS (SELECT *, sqrt(x * x + y * y) AS d FROM e), r AS (SELECT *, CASE WHEN d < 1e-15 THEN 0 ELSE {_R} / d END AS f FROM s)
SELECT event_id, round(CASE WHEN abs(x * f) < 5e-4 THEN 0 ELSE x * f END, 3) AS u, round(CASE WHEN abs(y * f) < 5e-4 THEN 0 ELSE y * f END, 3) AS v FROM r""")
def q_undistort(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500 - 0.05).alias("x"), (F.col("event_id") % 17 / 100 - 0.05).alias("y"))
    u, v = N.undistorted(F.lit(0.1), F.lit(0.01), F.col("x"), F.col("y"))
    return e.select("event_id", F.round(u, 3).alias("u"), F.round(v, 3).alias("v"))


@query("SELECT event_id FROM events WHERE value >= (SELECT quantile_cont(value, 0.2) FROM events)")
def q_confidence(spark, sf_dir):
    return G.confident(table(spark, sf_dir, "events"), "value").select("event_id")


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def q_percentiles(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", F.lit([0.1, 0.5, 0.9])).alias("p"))
    return p.select("event_type", *[F.round(F.get("p", F.lit(k)), 6).alias(n) for k, n in enumerate(("p10", "p50", "p90"))])


@query(f"WITH {_GRID} SELECT p_partkey, v FROM part JOIN g ON g.i = least(27, greatest(0, round_even(p_size / 4, 0)))::INT AND g.j = least(23, greatest(0, round_even(p_size / 2 - 3, 0)))::INT")
def q_pixel_colour(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 2 - 3).alias("u"), (F.col("p_size") / 4).alias("w"))
    return G.pixel_colours(p.withColumnRenamed("w", "v"), grid(spark, sf_dir).withColumnRenamed("v", "colour"), 24, 28).select("p_partkey", F.col("colour").alias("v"))


_IMAGE = """px AS (SELECT (event_id // 40 % 40)::INT AS i, (event_id % 40)::INT AS j, count(*) AS n, sum(user_id) AS u FROM events GROUP BY ALL),
im AS (SELECT i, j, CASE WHEN i BETWEEN 8 AND 24 AND j BETWEEN 10 AND 26 THEN 230 + n % 10 ELSE u % 40 END AS v FROM px)"""


@query(f"WITH {_IMAGE}, b AS (SELECT min(i) AS a, max(i) AS b, min(j) AS c, max(j) AS d FROM im WHERE v >= 200) SELECT unnest([a, a, b, b])::INT AS \"row\", unnest([c, d, c, d])::INT AS col FROM b")
def q_find_square(spark, sf_dir):
    """The squarest bright region of an image that is made of the events."""
    k = F.col("event_id")
    px = table(spark, sf_dir, "events").groupBy(F.floor(k / 40 % 40).cast("int").alias("i"), (k % 40).cast("int").alias("j")).agg(F.count("*").alias("n"), F.sum("user_id").alias("u"))
    lit = F.col("i").between(8, 24) & F.col("j").between(10, 26)
    found = G.find_square(px.select("i", "j", F.when(lit, 230 + F.col("n") % 10).otherwise(F.col("u") % 40).cast("int").alias("v")))
    return found.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


_SER = "s AS (SELECT (epoch_us(ts) // 3600000000) - (SELECT min(epoch_us(ts)) // 3600000000 FROM events) AS t, count(*)::DOUBLE AS v FROM events GROUP BY 1)"


def series(spark, sf_dir):
    h = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    e = table(spark, sf_dir, "events").select(h.alias("h"))
    first = e.agg(F.min("h").alias("h0"))
    return e.join(F.broadcast(first)).groupBy((F.col("h") - F.col("h0")).alias("t")).agg(F.count("*").cast("double").alias("v"))


@query(f"WITH {_SER}, k(k) AS (VALUES (0), (1), (7), (30), (60)) SELECT k, round(sqrt(sum(v * cos(-2 * pi() * (k * t % 720) / 720)) ** 2 + sum(v * sin(-2 * pi() * (k * t % 720) / 720)) ** 2), 3) AS magnitude FROM s, k GROUP BY k")
def q_dft(spark, sf_dir):
    return S.spectrum(series(spark, sf_dir), 720, [0, 1, 7, 30, 60]).select("k", F.round("magnitude", 3).alias("magnitude"))


@query(f"WITH {_SER} SELECT (x.t - h.t)::INT AS lag, round(sum(h.v * x.v), 3) AS r FROM s h JOIN s x ON x.t - h.t BETWEEN 0 AND 24 GROUP BY 1")
def q_xcorr(spark, sf_dir):
    s = series(spark, sf_dir)
    return S.cross_correlation(s, s, 24).select("lag", F.round("r", 3).alias("r"))


@query(f"WITH {_SER}, n AS (SELECT t, v, lag(v) OVER (ORDER BY t) AS a, lead(v) OVER (ORDER BY t) AS b FROM s), p AS (SELECT t, v, row_number() OVER (ORDER BY v DESC, t) AS r FROM n WHERE v > a AND v > b) SELECT t, v FROM p WHERE r <= 3")
def q_peaks(spark, sf_dir):
    return S.peaks(series(spark, sf_dir), [], "t", "v", 3).select("t", "v")


@query(f"WITH {_SER} SELECT t, round(2 * v + 0.5 * sum(v) OVER (ORDER BY t) + 0.1 * (v - coalesce(lag(v) OVER (ORDER BY t), v)), 5) AS control FROM s")
def q_pid(spark, sf_dir):
    return S.pid(series(spark, sf_dir), [], "t", "v", 2.0, 0.5, 0.1).select("t", F.round("control", 5).alias("control"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
k(user_id, i, x, p) AS (SELECT DISTINCT user_id, 0::BIGINT, 0.0::DOUBLE, 50.0::DOUBLE FROM events UNION ALL SELECT k.user_id, e.i, k.x + (k.p + 8) / (k.p + 8 + 15) * (e.value - k.x), (1 - (k.p + 8) / (k.p + 8 + 15)) * (k.p + 8) FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i + 1)
SELECT user_id, round(arg_max(x, i), 5) AS x, round(arg_max(p, i), 6) AS p FROM k GROUP BY user_id""")
def q_kalman(spark, sf_dir):
    states = Q.Ordered(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"]).scan(Q.Kalman("value", 8.0, 15.0, 50.0))
    last = states.groupBy("user_id").agg(F.max_by(F.struct("x", "p"), "event_id").alias("k"))
    return last.select("user_id", F.round("k.x", 5).alias("x"), F.round("k.p", 6).alias("p"))


_TRACK = "c AS (SELECT user_id, event_id AS t, value - 25.0 AS re, (event_id * 37 % 101 - 50)::DOUBLE AS im FROM events)"


@query(f"""WITH {_TRACK}, d AS (SELECT user_id, atan2(im, re) - lag(atan2(im, re)) OVER (PARTITION BY user_id ORDER BY t) AS d FROM c)
SELECT user_id, round(coalesce(sum(d - 2 * pi() * round(round(d / (2 * pi()), 9))), 0) / (2 * pi()), 6) AS turns FROM d GROUP BY user_id""")
def q_winding(spark, sf_dir):
    """Turns of each user's track round a point."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("t"), (F.col("value") - 25.0).alias("re"), (F.col("event_id") * 37 % 101 - 50).cast("double").alias("im"))
    return S.winding(e, ["user_id"], "t", "re", "im").select("user_id", F.round("turns", 6).alias("turns"))


@query("""WITH s AS (SELECT event_id, value AS sx, value / 3 AS sy, event_id % 30 AS t FROM events), r AS (SELECT *, sqrt(((sx - sy) / 2) ** 2 + t * t) AS r FROM s)
SELECT event_id, round(r, 6) AS mohr_radius, round((sx + sy) / 2 + r, 6) AS mohr_high, round((sx + sy) / 2 - r, 6) AS mohr_low, round(1 / (2 * pi() * sqrt((event_id % 9 + 1) * 0.01::DOUBLE * (event_id % 7 + 1) * 1e-6)), 4) AS resonance,
round(1 - 300 / (301.0::DOUBLE + sx), 6) AS carnot, round(80e6 * pi() * ((event_id % 10 + 1) / 100.0::DOUBLE) ** 3 / 2, 2) AS torque FROM r""")
def q_engineering(spark, sf_dir):
    """Stresses, resonance, efficiency and torque of each event's values."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    r, hi, lo = E.mohr(F.col("value"), F.col("value") / 3, (k % 30).cast("double"))
    return e.select(
        "event_id", F.round(r, 6).alias("mohr_radius"), F.round(hi, 6).alias("mohr_high"), F.round(lo, 6).alias("mohr_low"),
        F.round(E.resonance((k % 9 + 1) * F.lit(0.01), (k % 7 + 1) * F.lit(1e-6)), 4).alias("resonance"),
        F.round(E.carnot(F.lit(300.0), 301.0 + F.col("value")), 6).alias("carnot"), F.round(E.torsion_torque(F.lit(80e6), (k % 10 + 1) / 100), 2).alias("torque"),
    )


def sizes(spark, sf_dir):
    """The different sizes of parts: what a sweep gives hangs on nothing else."""
    return table(spark, sf_dir, "part").select("p_size").distinct()


def best_of_parts(spark, sf_dir, sweep, at: str, value: str):
    """Each part's largest value of its size's sweep and the least place that has it; of rows of one key the best."""
    best = lambda df, key: df.groupBy(key).agg(F.max_by(at, F.struct(value, -F.col(at))).alias(at), F.max(value).alias(value))
    found = best(sweep, "p_size").withColumnRenamed("p_size", "_size")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return best(parts.join(found, F.col("p_size").eqNullSafe(F.col("_size")), "left"), "p_partkey")


@query("""WITH s AS (SELECT p_partkey, p_size, 0.05 * k AS a FROM part, range(20, 61) r(k)), l AS (SELECT p_partkey, round(a, 2) AS support, round(pi() ** 2 * 200e9 * (p_size * 1e-8) / greatest(a, 4 - a) ** 2, 2) AS load FROM s)
SELECT p_partkey, arg_max(support, (load, -support))::DOUBLE AS support, max(load) AS load FROM l GROUP BY p_partkey""")
def q_buckling_sweep(spark, sf_dir):
    """The support that lets each part bear most, of 41 places."""
    at = F.explode(F.transform(F.sequence(F.lit(20), F.lit(60)), lambda k: k * F.lit(0.05)))
    s = sizes(spark, sf_dir).select("p_size", at.alias("a"))
    load = E.euler_load(F.lit(200e9), F.col("p_size") * F.lit(1e-8), F.lit(4.0), F.col("a"))
    s = s.select("p_size", F.round("a", 2).alias("support"), F.round(load, 2).alias("load"))
    return best_of_parts(spark, sf_dir, s, "support", "load")


@query("""WITH s AS (SELECT p_partkey, p_size, 0.05 * k AS v FROM part, range(401) r(k)), p AS (SELECT p_partkey, round(v, 2) AS v, round(v * p_size * (1 - exp((v - 20.0) / 1.5)), 4) AS p FROM s)
SELECT p_partkey, arg_max(v, (p, -v))::DOUBLE AS v, max(p)::DOUBLE AS p FROM p GROUP BY p_partkey""")
def q_power_point(spark, sf_dir):
    """The voltage at which a cell of each part's current gives most, of 401."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(400)), lambda k: k * F.lit(0.05)))
    s = sizes(spark, sf_dir).select("p_size", at.alias("v"))
    s = s.select("p_size", F.round("v", 2).alias("v"), F.round(F.col("v") * E.cell_current(F.col("v"), F.col("p_size"), 20.0, 1.5), 4).alias("p"))
    return best_of_parts(spark, sf_dir, s, "v", "p")


@query("""SELECT event_id, round(pow(2 / 2.4 * (1 + 0.2 * m * m), 3) / m, 4) AS area, round(sqrt((1 + 0.2 * m * m) / (1.4 * m * m - 0.2)), 6) AS after, round(1 + 2.8 / 2.4 * (m * m - 1), 6) AS pressure
FROM (SELECT event_id, 1.0 + 0.01 * (event_id % 300)::DOUBLE AS m FROM events)""")
def q_normal_shock(spark, sf_dir):
    m = F.col("mach")
    e = table(spark, sf_dir, "events").select("event_id", (1.0 + 0.01 * (F.col("event_id") % 300)).alias("mach"))
    return e.select("event_id", F.round(E.mach_area(m), 4).alias("area"), F.round(E.mach_after_shock(m), 6).alias("after"), F.round(E.shock_pressure_ratio(m), 6).alias("pressure"))


@query(r"""WITH p AS (SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'him: ' WHEN 'user' THEN 'me: ' ELSE '' END || regexp_replace(text, '\s+', ' ', 'g'), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1),
l AS (SELECT conv_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT conv_id, string_split(t, chr(10)) AS x FROM p)),
g AS (SELECT conv_id, pos, trim(line) AS line, lower(regexp_extract(trim(line), '(?i)^(him|her|me|he|she|i|you|them|scammer|victim|target)\b[:\-]?\s*(.+)$', 1)) AS tag, regexp_extract(trim(line), '(?i)^(him|her|me|he|she|i|you|them|scammer|victim|target)\b[:\-]?\s*(.+)$', 2) AS said FROM l WHERE trim(line) <> ''),
n AS (SELECT *, sum((tag <> '')::INT) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS turn FROM g)
SELECT conv_id, turn, CASE WHEN max(tag) IN ('me', 'victim', 'target', 'i', 'you') THEN 'V' ELSE 'S' END AS speaker, md5(string_agg(CASE WHEN tag <> '' THEN trim(said) ELSE line END, ' ' ORDER BY pos)) AS digest FROM n WHERE turn >= 0 AND (tag <> '' OR length(line) > 3) GROUP BY ALL""")
def q_pasted_chat(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.when(F.col("role") == "assistant", "him: ").when(F.col("role") == "user", "me: ").otherwise(""), F.regexp_replace("text", r"\s+", " "))
    p = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return P.pasted_chat(p, "conv_id", "t").select("conv_id", "turn", "speaker", F.md5("text").alias("digest"))


@query(r"""WITH t AS (SELECT conv_id, CASE role WHEN 'assistant' THEN 'Suspect: ' ELSE 'Innocent: ' END AS tag, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, CASE tag WHEN 'Suspect: ' THEN 'S' ELSE 'V' END AS speaker, md5(text) AS digest FROM t WHERE text <> ''""")
def q_dialogue_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.when(F.col("role") == "assistant", "Suspect: ").otherwise("Innocent: "), "text")
    d = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("l")))), lambda x: x["l"]), " ").alias("t"))
    return P.dialogue(d, "conv_id", "t").select("conv_id", "turn", "speaker", F.md5("text").alias("digest"))


@query(rf"""WITH s AS (SELECT item_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS k FROM (SELECT item_id, list_filter(list_transform({texts.SENT}, lambda x: trim(x)), lambda x: x <> '') AS l FROM benchmark)),
g AS (SELECT item_id, k // 3 AS g, string_agg(s, ' ' ORDER BY k) AS t FROM s GROUP BY ALL) SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY g) - 1)::INT AS turn, md5(t) AS digest FROM g WHERE length(t) > 15""")
def q_letter_chunks(spark, sf_dir):
    return P.letter_messages(table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "turn", F.md5("text").alias("digest"))


@query(r"""WITH h AS (SELECT page_id, url, regexp_extract_all(html, '<a\b[^>]*?href="([^"]+)"', 1) AS l FROM pages), u AS (SELECT page_id, url, unnest(l) AS h, generate_subscripts(l, 1) AS k FROM h),
a AS (SELECT page_id, CASE WHEN regexp_matches(h, '^[a-z]+://') THEN h ELSE regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || h END AS link, min(k) AS k FROM u GROUP BY ALL) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS ord, link FROM a""")
def q_page_links(spark, sf_dir):
    return P.page_links(table(spark, sf_dir, "pages"), "page_id", "url", "html")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '^\s+|\s+$', '', 'g') AS title, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages)
SELECT page_id, title, md5(text) AS digest FROM p WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) >= 40""")
def q_page_article(spark, sf_dir):
    return P.page_article(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "title", F.md5("text").alias("digest"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
k(user_id, i, id, t, accepted, held) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, false, []::DOUBLE[] FROM events UNION ALL
SELECT user_id, i, event_id, t, len(h) < 5, CASE WHEN len(h) < 5 THEN list_append(h, t) ELSE h END FROM (SELECT e.user_id, e.i, e.event_id, e.t, list_filter(k.held, lambda x: e.t - x <= 604800) AS h FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i + 1))
SELECT user_id, t AS "at", id, accepted FROM k WHERE i > 0""")
def q_rate_limiter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("id"))
    return rates.limited(e, "user_id", "at", 7 * 86400.0, 5)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS place FROM documents")
def q_seeded_shuffle(spark, sf_dir):
    """Each document's place in a shuffled order."""
    return R.shuffled_places(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3)


_RIDGE = """WITH RECURSIVE x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i, label::DOUBLE AS y FROM embeddings),
g AS (SELECT a.i, b.i AS j, sum(a.e * b.e) + max((a.i = b.i)::INT) AS v FROM x a JOIN x b USING (vec_id) GROUP BY ALL UNION ALL SELECT i, 65, sum(e * y) FROM x GROUP BY i),
rows_ AS (SELECT i, list(v ORDER BY j) AS r FROM g GROUP BY i), s(k, m) AS (SELECT 1, list(r ORDER BY i) FROM rows_ UNION ALL
SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN p ELSE list_transform(r, lambda v, j: v - r[k] * p[j]) END) FROM (SELECT k, m, list_transform(m[k], lambda v: v / m[k][k]) AS p FROM s WHERE k <= 64)),
w AS (SELECT list_transform(m, lambda r: r[65]) AS w FROM s WHERE k = 65), mean AS (SELECT avg(y) AS y FROM x), means AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(e) AS m FROM x GROUP BY i))"""


@query(f"{_RIDGE} SELECT i::INT AS dimension, round(w[i], 5) AS weight FROM w, range(1, 65) r(i) UNION ALL SELECT 0, round(mean.y - list_sum(list_transform(range(1, 65), lambda i: w[i] * m[i])), 5) FROM w, mean, means")
def q_ridge(spark, sf_dir):
    """Weights of all dimensions; dimension 0 is the intercept."""
    beta, b0 = comments.ridge(table(spark, sf_dir, "embeddings"), "embedding", "label", 64)
    return listed(spark, [(k, round(float(w), 5)) for k, w in enumerate([b0, *beta])], "dimension int, weight double")


@query()
def q_out_of_fold(spark, sf_dir):
    from quillstone.plans import scores

    return models.out_of_fold(scores.scored(spark, sf_dir), ["s", "n"], "y", "doc_id", n=3).select("doc_id", "y", F.round("p", 4).alias("p"))


@query("SELECT user_id, round(sum(s), 6) AS score FROM (SELECT user_id, value * value + 0.5 * (event_id % 3) ** 2 AS s FROM events) GROUP BY 1")
def q_quadratic_cost(spark, sf_dir):
    c = E.quadratic_cost(F.col("value"), F.col("event_id") % 3, 1.0, 0.5)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(c), 6).alias("score"))


@query(r"SELECT event_id, json_extract_string(props, '$.k')::INT AS k, list_transform(regexp_extract_all(props, '-?\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS numbers FROM events")
def q_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), T.numbers(F.col("props")).alias("numbers"))


@query("SELECT user_id, count(*) AS n, max(gap) AS longest FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) GROUP BY 1")
def q_gaps(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("gap", us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts")))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("gap").alias("longest"))


_ARM = (1.0, 0.8, 0.5)


@query("""WITH a AS (SELECT event_id, radians(10 + event_id % 40) AS a1, radians(20 + event_id % 60) AS a2, radians(-30 + event_id % 50) AS a3 FROM events)
SELECT event_id, round(cos(a1) + 0.8 * cos(a1 + a2) + 0.5 * cos(a1 + a2 + a3), 6) AS x, round(sin(a1) + 0.8 * sin(a1 + a2) + 0.5 * sin(a1 + a2 + a3), 6) AS y,
round(degrees(a1), 4) AS a1, round(degrees(a2), 4) AS a2, round(degrees(a3), 4) AS a3, abs(0.8 * sin(a2)) > 0.5 AS far_from_singular FROM a""")
def q_planar_arm(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.radians(10 + i % 40).alias("a1"), F.radians(20 + i % 60).alias("a2"), F.radians(-30 + i % 50).alias("a3"))
    x, y = E.planar_arm((F.col("a1"), F.col("a2"), F.col("a3")), _ARM)
    p = e.select("event_id", x.alias("x"), y.alias("y"), (F.col("a1") + F.col("a2") + F.col("a3")).alias("h"))
    back = E.planar_arm_angles(F.col("x"), F.col("y"), F.col("h"), _ARM)
    out = p.select("event_id", *texts.r6("x", "y"), *[b.alias(n) for n, b in zip(("a1", "a2", "a3"), back, strict=True)])
    return out.select("event_id", "x", "y", *[F.round(F.degrees(n), 4).alias(n) for n in ("a1", "a2", "a3")], (F.abs(E.elbow_determinant(F.col("a2"), 1.0, 0.8)) > 0.5).alias("far_from_singular"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / 10 AS ntu, least(0.95, l_discount::DOUBLE * 8) AS c, l_tax::DOUBLE AS tax FROM lineitem), e AS (SELECT *, (1 - exp(-ntu * (1 - c))) / (1 - c * exp(-ntu * (1 - c))) AS e FROM s)
SELECT l_orderkey, l_linenumber, round(e, 6) AS effectiveness, round(120 - e * c * (120 - 20), 4) AS hot_out, round(105.6 * 30 / (24 + tax), 6) AS rescaled FROM e""")
def q_heat_exchanger(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") / 10).alias("ntu"), F.least(F.lit(0.95), F.col("l_discount").cast("double") * 8).alias("c"), F.col("l_tax").cast("double").alias("tax"))
    l = l.withColumn("e", E.counterflow_effectiveness(F.col("ntu"), F.col("c")))
    out = E.counterflow_outlet(F.lit(120.0), F.lit(20.0), F.col("e"), F.col("c"))
    return l.select("l_orderkey", "l_linenumber", F.round("e", 6).alias("effectiveness"), F.round(out, 4).alias("hot_out"), F.round(E.rescaled_frequency(F.lit(105.6), F.lit(30.0), 24 + F.col("tax")), 6).alias("rescaled"))

