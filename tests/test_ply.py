"""The point cloud data source: ranges of records, formats, headers and writers."""

import struct

import pytest
from pyspark.sql import functions as F
from quillstone.sources import clouds, ply


def binary(rows, order="<", before=b"", head=""):
    name = {"<": "little", ">": "big"}[order]
    h = f"ply\nformat binary_{name}_endian 1.0\n{head}element vertex {len(rows)}\nproperty double x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    return h.encode() + before + b"".join(struct.pack(f"{order}dffBBB", *r) for r in rows) + b"\x03" + bytes(12)


ROWS = [(k / 7, float(k), -float(k), k % 256, 1, 2) for k in range(1000)]


@pytest.mark.parametrize("order", ["<", ">"])
def test_one_binary_file_is_many_tasks(spark, tmp_path, order):
    """Elements before and after the vertices are left out."""
    (tmp_path / "a.ply").write_bytes(binary(ROWS, order, bytes(24), "element camera 3\nproperty float a\nproperty int b\n"))
    got = ply.read(spark, str(tmp_path / "a.ply"), 90)
    assert got.rdd.getNumPartitions() == 12
    assert sorted((r.x, r.y, r.z, r.r, r.g, r.b) for r in got.collect()) == sorted((x, y, z, r, g, b) for x, y, z, r, g, b in ROWS)


@pytest.mark.parametrize("ending", ["\n", ""])
def test_ascii_lines_are_dealt_once(spark, tmp_path, ending):
    lines = [f"{k}.25 {'0' * (k % 40)}{k} {-k}" for k in range(500)]
    (tmp_path / "t.ply").write_text("ply\nformat ascii 1.0\ncomment made here\nelement vertex 500\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + "\n".join(lines) + ending)
    for each in (1, 3, 17, 1000):
        got = sorted((r.x, r.y, r.z, r.r) for r in ply.read(spark, str(tmp_path), each).collect())
        assert got == sorted((k + 0.25, float(k), -float(k), None) for k in range(500)), each


def test_ascii_with_faces_counts_its_vertices(spark, tmp_path):
    (tmp_path / "t.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n1 2 3\n4 5 6\n3 0 1 1\n")
    assert sorted((r.x, r.y, r.z) for r in ply.read(spark, str(tmp_path), 1).collect()) == [(1, 2, 3), (4, 5, 6)]


def test_written_files_come_back(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(float(k), 0.5, -1.0, k % 200, 3, 4) for k in range(300)], "x double, y double, z double, r short, g short, b short").repartition(4)
    ply.write(df, out)
    assert len(list((tmp_path / "out").glob("*.ply"))) == 4
    assert sorted((r.x, r.r) for r in ply.read(spark, out, 50).collect()) == [(float(k), k % 200) for k in range(300)]
    # other readers know these files too
    assert sum(len(clouds.parse_ply(f.read_bytes())) for f in (tmp_path / "out").glob("*.ply")) == 300
    ply.write(df.limit(5).select("x", "y", "z"), out, "overwrite")
    again = ply.read(spark, out).collect()
    assert len(again) == 5 and all(r.r is None for r in again)


def test_empty_and_wrong_files(spark, tmp_path):
    out = str(tmp_path / "none")
    ply.write(spark.createDataFrame([], "x double, y double, z double").coalesce(1), out)
    assert ply.read(spark, out).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.ply").write_bytes(b"plain text")
    with pytest.raises(Exception, match="not a PLY file"):
        ply.read(spark, str(tmp_path / "bad")).count()
    cut = binary(ROWS)[:-4000]
    (tmp_path / "cut.ply").write_bytes(cut)
    with pytest.raises(Exception, match="ends before its vertices"):
        ply.read(spark, str(tmp_path / "cut.ply"), 10**6).select(F.sum("x")).collect()


def test_tasks_of_a_read_are_bounded(spark, tmp_path):
    df = spark.range(0, 12_000, 1, 1).select(F.col("id").cast("double").alias("x"), F.lit(0.5).alias("y"), F.lit(1.0).alias("z"), (F.col("id") % 200).cast("short").alias("r"), F.lit(0).cast("short").alias("g"), F.lit(255).cast("short").alias("b"))
    ply.write(df, out := str(tmp_path / "many"))
    got = ply.read(spark, out, 10)
    parts = ply.PlyReader({"path": out, "recordspertask": "10"}).partitions()
    assert len(parts) == ply.MOST_TASKS and sum(p.last - p.first for p in parts) == 12_000
    assert [p.last - p.first for p in ply.PlyReader({"path": out, "recordspertask": "5000"}).partitions()] == [5000, 5000, 2000]
    assert got.agg(F.count("*"), F.sum("x")).first()[:] == (12_000, 12_000 * 11_999 / 2)


def test_a_large_cloud_is_dealt_into_files(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("key"), "id", F.col("id").cast("double").alias("x"), F.lit(0.5).alias("y"), F.lit(1.0).alias("z"))
    files = clouds.encode_ply(clouds.dealt(df, "id", 300), "key", "part")
    sizes = files.select("key", F.length("content").alias("n")).collect()
    assert len(sizes) == 20 and max(r.n for r in sizes) < 300 * 12 + 200
    got = clouds.vertices(files.select(F.col("key").alias("path"), "content")).groupBy("path").agg(F.count("*").alias("n"), F.sum("x").alias("x")).collect()
    assert sorted((r.path, r.n, r.x) for r in got) == [("0", 1500, 1500 * 1499.0), ("1", 1500, 1500 * 1499.0 + 1500)]
