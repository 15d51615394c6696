"""LAS files, point formats 0 to 10, as a Spark data source. LAZ needs a decoder that isn't here.

`spark.dataSource.register(LasDataSource)`, then `spark.read.format("las").option("path", "a.las,b.las").load()`. Every partition
is a slice of records, read by its task; headers are read on the driver and must agree.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.model import Transform
from .files import created, opened
from .points import STORED

#: Records of a partition.
SLICE = 1 << 20

_XYZ = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2")]
_OLD = [*_XYZ, ("flags", "u1"), ("class_flags", "u1"), ("angle", "i1"), ("user_data", "u1"), ("source", "<u2")]
_NEW = [*_XYZ, ("flags", "u1"), ("class_flags", "u1"), ("class", "u1"), ("user_data", "u1"), ("angle", "<i2"), ("source", "<u2"), ("gps", "<f8")]
_GPS, _RGB, _NIR = [("gps", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")]
_WAVE = [("wave_index", "u1"), ("wave_offset", "<u8"), ("wave_size", "<u4"), ("wave_at", "<f4"), ("wx", "<f4"), ("wy", "<f4"), ("wz", "<f4")]
#: The records of LAS point formats.
FORMATS = {
    0: _OLD, 1: _OLD + _GPS, 2: _OLD + _RGB, 3: _OLD + _GPS + _RGB, 4: _OLD + _GPS + _WAVE, 5: _OLD + _GPS + _RGB + _WAVE,
    6: _NEW, 7: _NEW + _RGB, 8: _NEW + _RGB + _NIR, 9: _NEW + _WAVE, 10: _NEW + _RGB + _NIR + _WAVE,
}


@dataclass(frozen=True)
class Header:
    path: str
    point_format: int
    record_length: int
    data_offset: int
    count: int
    transform: Transform
    crs: str | None


def read_header(path: str) -> Header:
    if path.lower().endswith(".laz"):
        raise ValueError(f"{path}: LAZ can't be decoded here; convert it to LAS first")
    with opened(path) as f:
        f.seek(0, 2)
        size = f.tell()
        f.seek(0)
        head = f.read(375)
        if head[:4] != b"LASF":
            raise ValueError(f"{path} is no LAS file")
        minor, (header_size, data_offset, vlrs) = head[25], struct.unpack_from("<HII", head, 94)
        kind, record_length, count = struct.unpack_from("<BHI", head, 104)
        if kind & 0x80:
            raise ValueError(f"{path}: compressed points (LAZ) can't be decoded here")
        if minor >= 4:
            count = struct.unpack_from("<Q", head, 247)[0]
        if kind not in FORMATS or np.dtype(FORMATS[kind]).itemsize > record_length:
            raise ValueError(f"{path}: point format {kind} isn't supported")
        numbers = struct.unpack_from("<6d", head, 131)
        f.seek(header_size)
        crs = _crs(f, vlrs)
    if data_offset + count * record_length > size:
        raise ValueError(f"{path} is shorter than its header says")
    return Header(path, kind, record_length, data_offset, count, Transform(numbers[:3], numbers[3:]), crs)


def _crs(f, vlrs: int) -> str | None:
    """The WKT of the coordinate system, else EPSG:n from the GeoTIFF keys, else None."""
    wkt, keys = None, {}
    for _ in range(vlrs):
        head = f.read(54)
        user, record, length = head[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", head, 18)
        data = f.read(length)
        if user == b"LASF_Projection" and record == 2112:
            wkt = data.rstrip(b"\0").decode("utf-8", "replace")
        elif user == b"LASF_Projection" and record == 34735:
            entries = np.frombuffer(data[8 : 8 + (len(data) - 8) // 8 * 8], "<u2").reshape(-1, 4)
            keys = {int(k): int(v) for k, location, _, v in entries if location == 0}
    if wkt:
        return wkt
    if 4096 in keys:
        raise ValueError("separate vertical coordinate systems aren't supported")
    code = next((keys[k] for k in (3072, 2048) if 1024 <= keys.get(k, 0) <= 32766), None)
    return f"EPSG:{code}" if code else None


def check_same(headers: Sequence[Header]) -> None:
    """Files of one cloud share transform, point format, record length and coordinate system."""
    if not headers:
        raise ValueError("at least one input is required")
    for h in headers[1:]:
        for what in ("transform", "point_format", "record_length", "crs"):
            if getattr(h, what) != getattr(headers[0], what):
                raise ValueError(f"{h.path}: {what} differs from that of {headers[0].path}")


def records_to_columns(data: bytes, header: Header) -> dict[str, np.ndarray | list]:
    """The stored columns of raw records; absent ones are left out."""
    layout = FORMATS[header.point_format]
    extra = header.record_length - np.dtype(layout).itemsize
    r = np.frombuffer(data, np.dtype([*layout, ("extra", f"V{extra}")] if extra else layout))
    out: dict = {a: r[a] for a in ("x", "y", "z")} | {"intensity": r["intensity"].astype(np.int32)}
    flags, cf = r["flags"], r["class_flags"]
    if header.point_format >= 6:
        out |= {"return_number": flags & 15, "number_of_returns": flags >> 4, "classification": r["class"], "scan_angle": r["angle"] * np.float32(0.006)}
        bits = {"synthetic": cf & 1, "key_point": cf & 2, "withheld": cf & 4, "overlap": cf & 8, "scan_direction_flag": cf & 64, "edge_of_flight_line": cf & 128}
        out["scanner_channel"] = cf >> 4 & 3
    else:
        # class 12 of the old formats is what later became the overlap flag
        old = cf & 31
        out |= {"return_number": flags & 7, "number_of_returns": flags >> 3 & 7, "classification": np.where(old == 12, 1, old), "scan_angle": r["angle"].astype(np.float32)}
        bits = {"synthetic": cf & 32, "key_point": cf & 64, "withheld": cf & 128, "overlap": old == 12, "scan_direction_flag": flags & 64, "edge_of_flight_line": flags & 128}
        out["scanner_channel"] = np.zeros(len(r), np.int16)
    out |= {k: v.astype(bool) for k, v in bits.items()}
    out |= {"user_data": r["user_data"], "point_source_id": r["source"].astype(np.int32)}
    names = r.dtype.names
    for stored, raw in {"gps_time": "gps", "red": "red", "green": "green", "blue": "blue", "nir": "nir", "wave_packet_descriptor_index": "wave_index", "waveform_packet_size": "wave_size", "return_point_waveform_location": "wave_at", "waveform_x_t": "wx", "waveform_y_t": "wy", "waveform_z_t": "wz"}.items():
        if raw in names:
            out[stored] = r[raw]
    if "wave_offset" in names:
        out["waveform_data_offset"] = [int(v) for v in r["wave_offset"]]
    if extra:
        out["extra_bytes"] = [v.tobytes() for v in r["extra"]]
    return out


_ARROW = {"int": pa.int32(), "smallint": pa.int16(), "boolean": pa.bool_(), "float": pa.float32(), "double": pa.float64(), "bigint": pa.int64(), "binary": pa.binary(), "decimal(20,0)": pa.decimal128(20, 0)}
SCHEMA = "source_index bigint, " + ", ".join(f"{n} {k}" for n, k, _ in STORED)


@dataclass
class _Slice(InputPartition):
    header: Header
    first: int  # in the file
    count: int
    index: int  # of the first record among all files


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], records: int):
        self.headers = [read_header(p) for p in paths]
        check_same(self.headers)
        self.records = records

    def partitions(self) -> list[_Slice]:
        out, base = [], 0
        for h in self.headers:
            out += [_Slice(h, i, min(self.records, h.count - i), base + i) for i in range(0, h.count, self.records)]
            base += h.count
        return out

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        h = part.header
        with opened(h.path) as f:
            for at in range(0, part.count, 65536):
                n = min(65536, part.count - at)
                f.seek(h.data_offset + (part.first + at) * h.record_length)
                columns = records_to_columns(f.read(n * h.record_length), h)
                arrays = [pa.array(np.arange(n, dtype=np.int64) + part.index + at)]
                for name, kind, _ in STORED:
                    t = _ARROW[kind]
                    arrays.append(pa.array(columns[name], type=None if kind != "decimal(20,0)" else t).cast(t) if name in columns else pa.nulls(n, t))
                yield pa.RecordBatch.from_arrays(arrays, ["source_index", *[s[0] for s in STORED]])


class LasDataSource(DataSource):
    """Options: path, one or several separated by commas; records, of a partition. source_index counts over all files."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader([p for p in self.options["path"].split(",") if p], int(self.options.get("records", SLICE)))


def packed(columns: dict[str, np.ndarray], point_format: int) -> np.ndarray:
    """Records from their raw fields (names as in FORMATS); what isn't given is 0."""
    records = np.zeros(len(columns["x"]), FORMATS[point_format])
    for k, v in columns.items():
        records[k] = v
    return records


def write_las(path: str, columns: dict[str, np.ndarray], transform: Transform, point_format: int = 3, wkt: str | None = None) -> None:
    """A small LAS 1.4 file from raw record fields (names as in FORMATS); what isn't given is 0."""
    write_records(path, [packed(columns, point_format)], transform, point_format, wkt)


def write_records(path: str, parts: Sequence[np.ndarray], transform: Transform, point_format: int = 3, wkt: str | None = None) -> None:
    """A LAS 1.4 file of packed records, part after part, without another copy of them."""
    n = sum(map(len, parts))
    vlr = b""
    if wkt is not None:
        data = wkt.encode() + b"\0"
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(data), b"") + data
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<HII", head, 94, 375, 375 + len(vlr), int(bool(vlr)))
    struct.pack_into("<BHI", head, 104, point_format, np.dtype(FORMATS[point_format]).itemsize, n if point_format < 6 else 0)
    struct.pack_into("<6d", head, 131, *transform.scale, *transform.offset)
    struct.pack_into("<Q", head, 247, n)
    with created(path) as f:
        f.write(bytes(head) + vlr)
        for p in parts:
            f.write(p.view(np.uint8))


def write_batches(batches: Iterator[pa.RecordBatch], stem: str, transform: Transform, point_format: int = 3, wkt: str | None = None, records: int = SLICE) -> list[str]:
    """Writes batches of raw record fields as LAS files of up to `records` points each, whose paths begin with stem; gives them in order.

    Batches are packed as they come, so that no more is held than the records of one file.
    """
    held, size, made = [], 0, []

    def flush() -> None:
        path = f"{stem}-{len(made):05d}-{uuid.uuid4().hex}.las"
        write_records(path, held, transform, point_format, wkt)
        made.append(path)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, records - size)
            held.append(packed({c: some.column(c).to_numpy(zero_copy_only=False) for c in some.schema.names}, point_format))
            at, size = at + some.num_rows, size + some.num_rows
            if size == records:
                flush()
                held, size = [], 0
    if held:
        flush()
    return made


def write_las_parts(points: DataFrame, order: Sequence[str], folder: str, transform: Transform, point_format: int = 3, wkt: str | None = None, records: int = SLICE) -> list[str]:
    """Writes points, whose columns are raw record fields without nulls, in the order of some columns as LAS files of up to `records` points each.

    Gives the files in that order. Rows are sorted by range over all tasks; each task writes files of its own below `folder`, which driver and
    executors must share, and holds the points of one. A repeated task writes them again under other names, and those of the last
    one are given. Columns that the format doesn't have are left out. Without points there is one empty file.
    """
    fields = [c for c in points.columns if c in np.dtype(FORMATS[point_format]).names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made = write_batches(batches, f"{folder}/{part:05d}", transform, point_format, wkt, records)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(made), pa.int32()), pa.array(range(len(made)), pa.int32()), pa.array(made, pa.string())], ["part", "file", "path"])

    ordered = points.repartitionByRange(*order).sortWithinPartitions(*order).select(*fields)
    rows = sorted(ordered.mapInArrow(run, "part int, file int, path string").collect())
    if not rows:
        path = f"{folder}/empty.las"
        write_las(path, {"x": np.empty(0, np.int32)}, transform, point_format, wkt)
        return [path]
    return [r["path"] for r in rows]
