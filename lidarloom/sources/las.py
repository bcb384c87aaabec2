"""LAS files as Spark data sources: ``las`` for points, read and written, ``las_header`` for one row per file.

The header source reads 227 bytes of each file. The point source splits a file into ranges of records, one task each,
skips files and decodes only ranges whose header bounds meet the pushed filters on x and y, and reads fixed-size
records through numpy in blocks, so memory doesn't grow with the file. Paths must be readable by all executors.

A write is all or nothing: tasks stream their records into files of a hidden folder of the job, the commit gives the
files of the tasks that count their names, an abort deletes the folder. Headers are written last, when a file's number of
records and bounds are known.
"""

from __future__ import annotations

import glob
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

BLOCK = 200_000
#: Byte offset of red in the point formats that hold colours, and of GPS time: fixed values of the LAS layout.
COLOUR, GPS = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}, {1: 20, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}
HEADER = "filepath string, version string, point_format int, n_points long, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double, has_intensity boolean, has_colors boolean, attributes array<string>, x_range double, y_range double, area double"
#: Sizes of the point formats' own records; what a record has beyond is extra bytes, of these types by their codes.
SIZE = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
EXTRA = {1: "<u1", 2: "<i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
#: Names of the extra bytes that hold, as doubles, measures too large for a record's 16 bits.
WIDE = {"intensity": "wide intensity", "r": "wide red", "g": "wide green", "b": "wide blue"}
POINTS = "filepath string, x double, y double, z double, intensity float, r float, g float, b float"


def header(path: str) -> dict | None:
    """The header of a file, None where it is missing or isn't LAS."""
    try:
        with open(path, "rb") as f:
            raw = f.read(375)
    except OSError:
        return None
    if len(raw) < 227 or raw[:4] != b"LASF":
        return None
    major, minor = raw[24], raw[25]
    offset, = struct.unpack_from("<I", raw, 96)
    kind, size, old = raw[104] & 0x3F, *struct.unpack_from("<HI", raw, 105)
    scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", raw, 179)
    n = struct.unpack_from("<Q", raw, 247)[0] if minor >= 4 and len(raw) >= 255 and not old else old
    return {"path": path, "version": f"{major}.{minor}", "kind": kind, "size": size, "offset": offset, "n": n, "scale": scale, "shift": shift, "lo": (x0, y0, z0), "hi": (x1, y1, z1)}


def extra_bytes(h: dict) -> dict[str, tuple[str, int]]:
    """(type, offset in a record) of a file's extra bytes, by the names that its variable length record gives them."""
    at = SIZE.get(h["kind"], h["size"])
    if h["size"] <= at:
        return {}
    with open(h["path"], "rb") as f:
        raw = f.read(h["offset"])
    place, n = struct.unpack_from("<H", raw, 94)[0], struct.unpack_from("<I", raw, 100)[0]
    out = {}
    for _ in range(n):
        if place + 54 > len(raw):
            break
        user, number, length = raw[place + 2 : place + 18].rstrip(b"\0"), *struct.unpack_from("<HH", raw, place + 18)
        if user == b"LASF_Spec" and number == 4:
            for d in range(place + 54, place + 54 + length - 191, 192):
                kind = EXTRA.get(raw[d + 2])
                if kind:
                    out[raw[d + 4 : d + 36].rstrip(b"\0").decode("ascii", "replace")] = (kind, at)
                at += np.dtype(kind).itemsize if kind else raw[d + 3]
        place += 54 + length
    return out


def header_row(h: dict) -> tuple:
    (x0, y0, z0), (x1, y1, z1) = h["lo"], h["hi"]
    attributes = ["intensity", *(["gps_time"] if h["kind"] in GPS else []), "classification", *(["colors"] if h["kind"] in COLOUR else [])]
    return (h["path"], h["version"], h["kind"], h["n"], x0, x1, y0, y1, z0, z1, True, h["kind"] in COLOUR, attributes, x1 - x0, y1 - y0, (x1 - x0) * (y1 - y0))


def local(path: str) -> str:
    """A path of the shared folder as ``open`` takes it."""
    return urlparse(path).path if path.startswith("file:") else path


def files(options: dict) -> list[str]:
    path = local(options.get("path", ""))
    return sorted(glob.glob(os.path.join(path, "*.las")) if os.path.isdir(path) else glob.glob(path))


class FilePart(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p, 0, 0) for p in files(self.options)]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        found = header(partition.path)
        if found:
            yield header_row(found)


class PointReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.limits: dict[str, list[float]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds on x and y prune files; Spark still applies every filter itself."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("x", "y"):
                low, high = self.limits.setdefault(name, [-np.inf, np.inf])
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    low = max(low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = min(high, f.value)
                self.limits[name] = [low, high]
            yield f

    def partitions(self) -> list[InputPartition]:
        each = int(self.options.get("recordsperpartition", 2_000_000))
        out = []
        for p in files(self.options):
            h = header(p)
            if h and all(h["hi"][i] >= self.limits[a][0] and h["lo"][i] <= self.limits[a][1] for i, a in enumerate("xy") if a in self.limits):
                out += [FilePart(p, s, min(s + each, h["n"])) for s in range(0, h["n"], each)]
        return out

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        h = header(partition.path)
        names = ["x", "y", "z", "intensity"]
        formats, offsets = ["<i4", "<i4", "<i4", "<u2"], [0, 4, 8, 12]
        at = COLOUR.get(h["kind"])
        if at:
            names, formats, offsets = [*names, "r", "g", "b"], [*formats, "<u2", "<u2", "<u2"], [*offsets, at, at + 2, at + 4]
        extra = extra_bytes(h)
        wide = {c: WIDE[c] for c in ("intensity", *("rgb" if at else "")) if WIDE[c] in extra}
        for name in wide.values():
            names, formats, offsets = [*names, name], [*formats, extra[name][0]], [*offsets, extra[name][1]]
        record = np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": h["size"]})
        with open(partition.path, "rb") as f:
            f.seek(h["offset"] + partition.start * h["size"])
            left = partition.stop - partition.start
            while left:
                raw = np.frombuffer(f.read(min(BLOCK, left) * h["size"]), record)
                if not len(raw):
                    return
                left -= len(raw)
                xyz = [pa.array(raw[a] * h["scale"][i] + h["shift"][i]) for i, a in enumerate("xyz")]
                rgb = [pa.array(raw[wide.get(c, c)].astype(np.float32)) if at else pa.nulls(len(raw), pa.float32()) for c in "rgb"]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(raw)), *xyz, pa.array(raw[wide.get("intensity", "intensity")].astype(np.float32)), *rgb], ["filepath", "x", "y", "z", "intensity", "r", "g", "b"])


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (name in the job's folder, name to be)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class LasFile:
    """A file that takes records block by block. Coordinates count from the first block's least ones, in steps of
    ``scale``; what doesn't fit a record's fields is an error. A ``wide`` file has intensity and colours once more in extra
    bytes, as doubles; in their own fields they are held within 16 bits."""

    def __init__(self, path: str, scale: float, colours: bool, wide: bool = False):
        self.path, self.scale, self.colours, self.n = path, scale, colours, 0
        self.record = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("rest", "V6"), *([(c, "<u2") for c in "rgb"] if colours else []), *([(WIDE[c], "<f8") for c in ("intensity", *("rgb" if colours else ""))] if wide else [])])
        self.extra = [n for n in self.record.names if n in WIDE.values()]
        self.shift, self.lo, self.hi = None, np.full(3, np.inf), np.full(3, -np.inf)
        self.out = open(path, "wb")  # noqa: SIM115
        self.out.write(bytes(227) + pack_extra(self.extra))

    def add(self, t: pa.RecordBatch) -> None:
        raw = np.zeros(t.num_rows, self.record)
        xyz = np.stack([t.column(a).to_numpy(zero_copy_only=False) for a in "xyz"])
        if not np.isfinite(xyz).all():
            raise ValueError("a coordinate is null or not finite")
        if self.shift is None:
            self.shift = xyz.min(1)
        steps = np.round((xyz - self.shift[:, None]) / self.scale)
        if np.abs(steps).max() >= 2**31:
            raise ValueError(f"points lie more than 2^31 steps of {self.scale} apart: take a larger scale")
        back = steps * self.scale + self.shift[:, None]
        self.lo, self.hi = np.minimum(self.lo, back.min(1)), np.maximum(self.hi, back.max(1))
        for i, a in enumerate("xyz"):
            raw[a] = steps[i]
        for c in ("intensity", *("rgb" if self.colours else "")):
            v = t.column(c).fill_null(0).to_numpy(zero_copy_only=False)
            if not (np.isfinite(v) if self.extra else (v >= 0) & (v <= 65535)).all():
                raise ValueError(f"{c} is beyond 0 to 65535" if not self.extra else f"{c} is not finite")
            raw[c] = np.clip(v, 0, 65535)
            if self.extra:
                raw[WIDE[c]] = v
        self.out.write(raw.tobytes())
        self.n += t.num_rows

    def close(self) -> None:
        self.out.seek(0)
        self.out.write(pack_header(self.n, 2 if self.colours else 0, self.record.itemsize, (self.scale,) * 3, tuple(self.shift), tuple(self.lo), tuple(self.hi), len(pack_extra(self.extra))))
        self.out.close()


class PointWriter(DataSourceArrowWriter):
    """Points (x, y, z, intensity[, r, g, b][, file_number]) as ``strip-<file_number>-<n>.las``. A task begins a new file
    of a number after ``recordsperfile`` points, so a strip is as many files as its tasks write. With the option ``wide``,
    points whose intensity or colours don't fit 16 bits go to files of their own, which have them in extra bytes; without
    it they are an error."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.folder, self.overwrite = local(options["path"]), overwrite
        self.scale, self.each = float(options.get("scale", 0.001)), int(options.get("recordsperfile", 20_000_000))
        self.wide = str(options.get("wide", "false")).lower() == "true"
        missing = {"x", "y", "z", "intensity"} - set(schema.names)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        self.colours, self.numbered = {"r", "g", "b"} <= set(schema.names), "file_number" in schema.names
        # made here and not by the tasks, so that one that still runs after an abort can't write any more
        self.job = os.path.join(self.folder, f"_job-{uuid.uuid4().hex}")
        os.makedirs(self.job)

    def discard(self) -> None:
        """Deletes the job's folder, out of the way first, so that nothing is added to it meanwhile."""
        gone = f"{self.job}-gone"
        os.rename(self.job, gone)
        shutil.rmtree(gone, ignore_errors=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        open_: dict[tuple[int, bool], LasFile] = {}
        done = Written()

        def end(key: tuple[int, bool]) -> None:
            f = open_.pop(key)
            f.close()
            done.files.append((os.path.basename(f.path), f"strip-{key[0]:05d}-{uuid.uuid4().hex[:12]}.las"))

        def large(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(b.num_rows, bool)
            for c in ("intensity", *("rgb" if self.colours else "")):
                v = b.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                out |= ~((v >= 0) & (v <= 65535))
            return out

        try:
            for b in batches:
                numbers = b.column("file_number").to_numpy(zero_copy_only=False).astype(int) if self.numbered else np.zeros(b.num_rows, int)
                wide = large(b) if self.wide else np.zeros(b.num_rows, bool)
                for key in [(number, w) for number in np.unique(numbers).tolist() for w in (False, True)]:
                    own = np.flatnonzero((numbers == key[0]) & (wide == key[1]))
                    while len(own):
                        if key not in open_:
                            open_[key] = LasFile(os.path.join(self.job, f"{uuid.uuid4().hex}.las"), self.scale, self.colours, key[1])
                        room = self.each - open_[key].n
                        open_[key].add(b.take(pa.array(own[:room])))
                        own = own[room:]
                        if open_[key].n >= self.each:
                            end(key)
            for key in list(open_):
                end(key)
        finally:
            for f in open_.values():  # after an error: the abort deletes them
                f.out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for old in glob.glob(os.path.join(self.folder, "*.las")):
                os.remove(old)
        for m in messages:
            for name, final in m.files if m else ():
                os.replace(os.path.join(self.job, name), os.path.join(self.folder, final))
        self.discard()

    def abort(self, messages: list[Written | None]) -> None:
        self.discard()


class LasHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las_header"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(dict(self.options))


class LasPoints(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> PointReader:
        return PointReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PointWriter:
        return PointWriter(dict(self.options), schema, overwrite)


def enable(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasHeaders)
    spark.dataSource.register(LasPoints)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of all files with ``strip_id``, the first number in the file's name."""
    from pyspark.sql import functions as F

    from lidarloom.functions.geometry import strip_number

    enable(spark)
    return spark.read.format("las").load(path).withColumn("strip_id", strip_number(F.col("filepath")))


def pack_extra(names: list[str]) -> bytes:
    """The variable length record that describes extra bytes of doubles."""
    if not names:
        return b""
    rows = b"".join(bytes((0, 0, 10, 0)) + n.encode().ljust(32, b"\0") + bytes(156) for n in names)
    return struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(rows), b"") + rows


def pack_header(n: int, kind: int, size: int, scale: tuple, shift: tuple, lo: tuple, hi: tuple, more: int = 0) -> bytes:
    """A LAS 1.2 header, for a file with a variable length record of ``more`` bytes if that isn't 0."""
    out = bytearray(227)
    out[0:4], out[24], out[25] = b"LASF", 1, 2
    struct.pack_into("<HII", out, 94, 227, 227 + more, int(more > 0))
    out[104] = kind
    struct.pack_into("<HI", out, 105, size, n)
    struct.pack_into("<3d", out, 131, *scale)
    struct.pack_into("<3d", out, 155, *shift)
    struct.pack_into("<6d", out, 179, hi[0], lo[0], hi[1], lo[1], hi[2], lo[2])
    return bytes(out)
