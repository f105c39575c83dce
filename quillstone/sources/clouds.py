"""Point clouds, poses, matrices and judge files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The type names of the PLY format and their NumPy codes.
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
COLOURS = (("red", "r"), ("green", "g"), ("blue", "b"))
CLOUD = "path string, x double, y double, z double, r short, g short, b short"


def parse_ply(data: bytes):
    """A structured array of the vertices of an ASCII or binary little-endian file."""
    import numpy as np

    head, _, body = data.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    lines = head.decode("ascii", "replace").splitlines()
    if lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    form = next(x.split()[1] for x in lines if x.startswith("format"))
    count, columns, inside = 0, [], False
    for x in lines:
        w = x.split()
        if w[:1] == ["element"]:
            inside = w[1] == "vertex"
            count = int(w[2]) if inside else count
        elif w[:1] == ["property"] and inside:
            columns.append((w[2], "<" + PLY_TYPES[w[1]]))
    kind = np.dtype(columns)
    if form == "ascii":
        rows = [tuple(x.split()[: len(columns)]) for x in body.decode("ascii").splitlines() if x.strip()][:count]
        return np.array([tuple(float(v) for v in r) for r in rows], dtype=[(n, "f8") for n, _ in columns])
    if form != "binary_little_endian":
        raise ValueError(f"unknown format {form}")
    return np.frombuffer(body, dtype=kind, count=count)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y, z, r, g, b of the vertices of PLY files."""
    return vertices(spark.read.format("binaryFile").load(path))


def vertices(files: DataFrame) -> DataFrame:
    """The same of files at hand (path, content); colours null where a file has none.  One file is one task's memory."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                v = parse_ply(bytes(content))
                out = {"path": p} | {a: v[a].astype("float64") for a in "xyz"}
                for name, short in COLOURS:
                    out[short] = pd.array(v[name].astype("int64"), dtype="Int16") if name in v.dtype.names else pd.array([None] * len(v), dtype="Int16")
                yield pd.DataFrame(out)

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInPandas(run, CLOUD)


def ply_bytes(rows, binary: bool = True) -> bytes:
    """A PLY file of rows (x, y, z) or (x, y, z, r, g, b)."""
    import struct

    colour = bool(rows) and len(rows[0]) == 6 and rows[0][3] is not None
    head = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", f"element vertex {len(rows)}", *[f"property float {a}" for a in "xyz"]]
    head += [f"property uchar {n}" for n, _ in COLOURS] if colour else []
    out = ("\n".join([*head, "end_header"]) + "\n").encode()
    if binary:
        return out + b"".join(struct.pack("<fffBBB", *r[:3], *map(int, r[3:6])) if colour else struct.pack("<fff", *r[:3]) for r in rows)
    return out + "".join(" ".join([*(f"{x:.6f}" for x in r[:3]), *(str(int(x)) for x in (r[3:6] if colour else ()))]) + "\n" for r in rows).encode()


#: Points of a file where a cloud is dealt into several (some 300 bytes each while they are encoded).
MOST_IN_FILE = 25_000


def dealt(points: DataFrame, by: str, most: int = MOST_IN_FILE) -> DataFrame:
    """points with `part`, by the hash of a column: about `most` points at most, however many there are."""
    parts = max(1, -(-points.count() // most))
    return points.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))


def encode_ply(points: DataFrame, *keys: str, binary: bool = True) -> DataFrame:
    """The keys and content: one PLY file for each, whose points fit in memory as its file must; `part` (see dealt) as a further key bounds them."""
    import pandas as pd

    coloured, kinds = all(c in points.columns for c in "rgb"), dict(points.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = [*"xyz", *("rgb" if coloured else "")]
        return pd.DataFrame({k: [group[k].iloc[0]] for k in keys} | {"content": [ply_bytes(list(group[names].itertuples(index=False, name=None)), binary)]})

    return points.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "content binary"]))


def write_xyz(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """x y z with four digits, and colours if there are any."""
    place = F.format_string("%.4f %.4f %.4f", "x", "y", "z")
    line = F.concat_ws(" ", place, F.format_string("%d %d %d", "r", "g", "b")) if all(c in points.columns for c in "rgb") else place
    points.select(line.alias("value")).write.mode(mode).text(path)


#: The four keys of a pose.
POSE_KEYS = {"camposition": "position", "camforward": "forward", "camright": "right", "camup": "up"}
_NUMBER = r"-?\d+(?:\.\d+)?"
_POSE = rf"(?i)(Cam(?:Position|Forward|Right|Up))\s*:?\s*X\s*=\s*({_NUMBER})\s+Y\s*=\s*({_NUMBER})\s+Z\s*=\s*({_NUMBER})"


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """index and position, forward, right, up (three numbers each) of numbered blocks; `missing` lists absent keys, `repeated` tells of a key that stands twice."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^[ \t]*(\d+)[ \t]*\)[ \t]*\r?$((?:(?!^[ \t]*\d+[ \t]*\)[ \t]*\r?$)[\s\S])*)"), F.lit(0))).alias("block"))
    index = F.regexp_extract("block", r"(\d+)", 1).cast("int")
    found = [F.regexp_extract_all("block", F.lit(_POSE), F.lit(k)) for k in range(1, 5)]
    entries = F.transform(F.arrays_zip(*found), lambda e: F.struct(F.lower(e["0"]).alias("k"), F.array(*[e[str(i)].cast("double") for i in (1, 2, 3)]).alias("v")))
    held = blocks.select(index.alias("index"), entries.alias("e"))
    one = lambda key: F.get(F.filter("e", lambda x: x["k"] == key), F.lit(0))["v"]
    names = F.array(*[F.lit(k) for k in POSE_KEYS])
    return held.select("index", *[one(k).alias(n) for k, n in POSE_KEYS.items()], F.array_except(names, F.transform("e", lambda x: x["k"])).alias("missing"), (F.size("e") > F.size(F.array_distinct(F.transform("e", lambda x: x["k"])))).alias("repeated"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """k: a 3x3 matrix of the first nine numbers of a text."""
    n = F.transform(F.regexp_extract_all("value", F.lit(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    return spark.read.text(path, wholetext=True).select(F.array(F.slice(n, 1, 3), F.slice(n, 4, 3), F.slice(n, 7, 3)).alias("k"))


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """path and number, in the order of the number that ends the name."""
    files = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).cast("int").alias("number"))
    return files.orderBy("number", "path")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, value, whole: the numbers of judge files in order; whole numbers also as such, beyond what a double holds."""
    words = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(words).alias("pos", "w")).select("file", "pos", F.expr("try_cast(w as double)").alias("value"), F.expr("try_cast(w as bigint)").alias("whole"))


def grid_of(numbers: DataFrame, header: int = 2) -> DataFrame:
    """file, i, j, v: the grid that follows a header of rows, columns and perhaps more numbers."""
    size = numbers.groupBy("file").agg(F.max(F.when(F.col("pos") == 0, F.col("value"))).cast("int").alias("m"), F.max(F.when(F.col("pos") == 1, F.col("value"))).cast("int").alias("n"))
    k = F.col("pos") - header
    return numbers.join(size, "file").where((k >= 0) & (k < F.col("m") * F.col("n"))).select("file", F.floor(k / F.col("n")).cast("int").alias("i"), (k % F.col("n")).cast("int").alias("j"), F.coalesce("whole", F.col("value").cast("long")).alias("v"))


def queries_of(numbers: DataFrame, header: int = 2, width: int = 2) -> DataFrame:
    """file, q and args (`width` numbers) of the counted list of queries that follows a grid."""
    sizes = numbers.groupBy("file").agg(F.max(F.when(F.col("pos") == 0, F.col("value"))).alias("m"), F.max(F.when(F.col("pos") == 1, F.col("value"))).alias("n"))
    k = F.col("pos") - header - (F.col("m") * F.col("n")).cast("int") - 1  # the count of queries stands in between
    held = numbers.join(sizes, "file").where(k >= 0).select("file", F.floor(k / width).cast("int").alias("q"), (k % width).alias("a"), "value")
    return held.groupBy("file", "q").agg(F.array_sort(F.collect_list(F.struct("a", "value"))).alias("v")).select("file", "q", F.transform("v", lambda x: x["value"]).alias("args"))


def file_stem(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path)
