"""Point clouds as a Spark data source: `spark.read.format("ply")` and `df.write.format("ply")`.

A binary file is cut into ranges of whole records, so one large file is read by many tasks;
only headers are read when a query is planned.  An ASCII file that holds vertices alone is cut
at line ends; one that holds more elements is one task, as its vertices must be counted.
Each task of a writer makes one file of its own.

Files are opened through Arrow's file systems, so a path may be local or a URI of a store that
Arrow knows.

Defined results.  Colours are null where a file has none.  A file without vertices, or an empty
partition: no rows, and a file with a count of 0.  Not a PLY file, a list among the vertices'
properties or before them in a binary file: an error that names the file.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillstone.sources.clouds import CLOUD, COLOURS, PLY_TYPES

#: Records of a task and of a batch, and bytes in which a header must end.
EACH, BATCH, MOST_HEADER = 1_000_000, 65_536, 1 << 16
#: Tasks of a read, beside one for each file: ranges are longer where there would be more.
MOST_TASKS = 1_000
ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}


def opened(path: str):
    """The file system of a path and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Header:
    """What a file says of its vertices: where they start, how many there are, names and NumPy codes of their properties."""

    form: str
    start: int
    count: int
    columns: list[tuple[str, str]]
    alone: bool

    @property
    def kind(self):
        import numpy as np

        return np.dtype([(n, ORDERS[self.form] + c) for n, c in self.columns])


def read_header(data: bytes, path: str) -> Header:
    """data: the first bytes of a file."""
    import numpy as np

    mark = data.find(b"end_header")
    if not data.startswith(b"ply") or mark < 0:
        raise ValueError(f"not a PLY file: {path}")
    start = data.index(b"\n", mark) + 1
    form, elements = "", []
    for line in data[:mark].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], None if w[1] == "list" else PLY_TYPES[w[1]]))
    if form not in ORDERS:
        raise ValueError(f"unknown format {form}: {path}")
    names = [e[0] for e in elements]
    if "vertex" not in names:
        return Header(form, start, 0, [], True)
    at = names.index("vertex")
    needed = elements[: at + 1] if form != "ascii" else elements[at : at + 1]
    if any(code is None for *_, columns in needed for _, code in columns):
        raise ValueError(f"a list among the properties of vertices or before them: {path}")
    if form == "ascii":
        if any(n for _, n, _ in elements[:at]):
            raise ValueError(f"elements before the vertices: {path}")
    else:
        start += sum(n * np.dtype([(c, code) for c, code in columns]).itemsize for _, n, columns in elements[:at])
    return Header(form, start, elements[at][1], elements[at][2], at + 1 == len(elements))


@dataclass
class Range(InputPartition):
    """Records from `first` on of a binary file, or the lines that start in a range of bytes of an ASCII file."""

    path: str
    header: Header
    first: int
    last: int


class PlyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.each = options["path"], int(options.get("recordspertask", EACH))

    def _files(self) -> list[str]:
        from pyarrow import fs

        system, inside = opened(self.path)
        info = system.get_file_info(inside)
        prefix = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else ""
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [self.path]
        found = system.get_file_info(fs.FileSelector(inside, recursive=True))
        return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".ply"))

    def partitions(self) -> list[Range]:
        found = []
        for path in self._files():
            system, inside = opened(path)
            with system.open_input_file(inside) as f:
                size = f.size()
                found.append((path, size, read_header(f.read(min(size, MOST_HEADER)), path)))
        each, out = max(self.each, -(-sum(h.count for *_, h in found) // MOST_TASKS)), []
        for path, size, h in found:
            if h.form == "ascii":
                # some 30 bytes a line
                step = each * 30 if h.alone else max(1, size)
                out += [Range(path, h, a, min(a + step, size)) for a in range(h.start, size, step)] if h.count else []
            else:
                out += [Range(path, h, a, min(a + each, h.count)) for a in range(0, h.count, each)]
        return out or [Range("", Header("ascii", 0, 0, [], True), 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, inside = opened(part.path)
        with system.open_input_file(inside) as f:
            for rows in self._text(f, part) if part.header.form == "ascii" else self._binary(f, part):
                yield self._batch(part, rows)

    def _binary(self, f, part: Range):
        import numpy as np

        kind = part.header.kind
        for a in range(part.first, part.last, BATCH):
            n = min(BATCH, part.last - a)
            f.seek(part.header.start + a * kind.itemsize)
            data = f.read(n * kind.itemsize)
            if len(data) < n * kind.itemsize:
                raise ValueError(f"{part.path} ends before its vertices do")
            yield np.frombuffer(data, dtype=kind)

    def _text(self, f, part: Range):
        import numpy as np

        # a line belongs to the range that its first byte lies in
        f.seek(max(part.header.start, part.first - 1))
        data = io.BytesIO(f.read(part.last - max(part.header.start, part.first - 1)))
        if part.first > part.header.start:
            data.readline()
        lines = data.read().split(b"\n")
        if part.last < f.size() and lines[-1]:
            while b"\n" not in (more := f.read(256)) and more:
                lines[-1] += more
            lines[-1] += more.split(b"\n")[0]
        held = [x.split()[: len(part.header.columns)] for x in lines if x.strip()]
        if not part.header.alone:
            held = held[: part.header.count]
        for a in range(0, len(held), BATCH):
            yield np.array([tuple(map(float, x)) for x in held[a : a + BATCH]], dtype=[(n, "f8") for n, _ in part.header.columns])

    def _batch(self, part: Range, rows) -> pa.RecordBatch:
        columns = [pa.array([part.path] * len(rows)), *[pa.array(rows[a].astype("f8")) for a in "xyz"]]
        for name, _ in COLOURS:
            columns.append(pa.array(rows[name].astype("i2")) if name in rows.dtype.names else pa.nulls(len(rows), pa.int16()))
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in CLOUD.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    path: str


class PlyWriter(DataSourceArrowWriter):
    """A file for each task: x, y, z as floats and, if the rows have them, colours as bytes."""

    def __init__(self, options: dict, names: list[str], overwrite: bool) -> None:
        self.path, self.coloured, self.overwrite = options["path"], {"r", "g", "b"} <= set(names), overwrite
        self.kept = set() if overwrite else None
        if overwrite:
            from pyarrow import fs

            system, inside = opened(self.path)
            there = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
            self.kept = {f.path for f in there if f.path.endswith(".ply")}  # what is to go when all is written

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import numpy as np

        kind = np.dtype([(a, "<f4") for a in "xyz"] + ([(n, "u1") for n, _ in COLOURS] if self.coloured else []))
        body, count = [], 0
        for b in batches:
            rows = np.empty(b.num_rows, dtype=kind)
            for a in "xyz":
                rows[a] = b.column(a).to_numpy(zero_copy_only=False)
            for name, short in COLOURS if self.coloured else ():
                rows[name] = b.column(short).fill_null(0).to_numpy(zero_copy_only=False)
            body.append(rows.tobytes())
            count += b.num_rows
        system, inside = opened(self.path)
        system.create_dir(inside, recursive=True)
        file = f"{inside}/part-{uuid4().hex}.ply"
        with system.open_output_stream(file) as f:
            f.write(("\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {count}", *[f"property {'uchar' if kind[n].itemsize == 1 else 'float'} {n}" for n in kind.names], "end_header"]) + "\n").encode())
            for data in body:
                f.write(data)
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for old in self.kept or ():
            system.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class PlySource(DataSource):
    """Options: path; recordsPerTask, the vertices that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return CLOUD

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options)

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options, schema.fieldNames(), overwrite)


def read(spark: SparkSession, path: str, records_per_task: int = EACH) -> DataFrame:
    """path, x, y, z, r, g, b of the vertices of a file or of all .ply files of a folder."""
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").option("recordsPerTask", records_per_task).load(path)


def write(points: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each partition."""
    points.sparkSession.dataSource.register(PlySource)
    points.write.format("ply").mode(mode).save(path)
