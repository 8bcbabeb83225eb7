"""Glove archives read by member: only the bytes that are asked for leave the store.

An archive (npz) is a zip file of arrays. One pass over the archives' directories gives a row per pad with the place
and shape of its array; these rows, cut into ranges of samples, are what Spark partitions, and a task reads the
directory, the time stamps and its own range. An hour of a glove is no longer one Python row.
"""

from __future__ import annotations

import io
import sys
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajq.sources.files import PAD_IDS, TACTILE_SCHEMA, base_of, folder_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Samples that a task reads of an array in one range.
ROWS_PER_RANGE = 65_536
#: Samples of an output batch.
ROWS_PER_BATCH = 4_096
KINDS = ("tactile", "tf_tactile_x", "tf_tactile_y")
RANGES = "path string, pad int, first bigint, last bigint"


class Layout(NamedTuple):
    """Where the rows of an array lie within its member."""

    shape: tuple[int, ...]
    dtype: np.dtype
    start: int

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize


def open_path(path: str) -> Any:
    """A seekable file of any store that pyarrow knows."""
    from pyarrow import fs

    path = "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path
    store, root = fs.FileSystem.from_uri(path)
    return store.open_input_file(root)


def layout(member: Any) -> Layout:
    """The header of an array; only plain numbers in row order are taken."""
    version = np.lib.format.read_magic(member)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, columnwise, dtype = read(member)
    if dtype.kind not in "fiu" or (columnwise and len(shape) > 1):
        raise ValueError("not an array of numbers in row order")
    return Layout(shape, dtype, member.tell())


def rows_of(archive: zipfile.ZipFile, name: str, first: int, last: int) -> np.ndarray:
    """Rows first..last-1 of an array. A stored member is read in place; a compressed one is unpacked up to there, piece by piece."""
    with archive.open(f"{name}.npy") as member:
        at = layout(member)
        member.seek(at.start + first * at.row_bytes)
        data = member.read((last - first) * at.row_bytes)
    if len(data) != (last - first) * at.row_bytes:
        raise EOFError(f"{name} ends early")
    return np.frombuffer(data, at.dtype).reshape(last - first, *at.shape[1:])


def ranges_of(file: Any, pads: Sequence[int], rows: int = ROWS_PER_RANGE) -> list[tuple[int, int, int]]:
    """(pad, first, last) of an archive's pads; none if any of its arrays is not what it should be."""
    out = []
    with zipfile.ZipFile(file) as archive:
        infos = {i.filename: i for i in archive.infolist()}
        with archive.open("timestamps.npy") as member:
            n_times = int(np.prod(layout(member).shape, dtype=np.int64))
        for pad in pads:
            info = infos.get(f"tactile_{pad}.npy")
            if info is None:
                continue
            with archive.open(info) as member:
                at = layout(member)
            if len(at.shape) != 3 or info.file_size < at.start + at.shape[0] * at.row_bytes:
                raise ValueError("not a series of grids")
            n = min(at.shape[0], n_times)
            step = rows if info.compress_type == zipfile.ZIP_STORED else max(1, n)
            out += [(pad, a, min(n, a + step)) for a in range(0, n, step)]
    return out


def series_of(file: Any, pad: int, first: int, last: int, rows: int = ROWS_PER_BATCH) -> Iterator[dict[str, Any]]:
    """The samples of a range in batches: times, grids, and both shears where they fit."""
    with zipfile.ZipFile(file) as archive:
        names = set(archive.namelist())
        shears = [f"{k}_{pad}" for k in KINDS[1:] if f"{k}_{pad}.npy" in names]
        if len(shears) == 2:
            for s in shears:
                with archive.open(f"{s}.npy") as member:
                    try:
                        fits = layout(member).shape[:1] >= (last,)
                    except ValueError:
                        fits = False
                if not fits:
                    shears = []
                    break
        for a in range(first, last, rows):
            b = min(last, a + rows)
            times = np.rint(rows_of(archive, "timestamps", a, b).astype(np.float64).reshape(b - a) * 1e9).astype(np.int64)
            grid = rows_of(archive, f"tactile_{pad}", a, b)
            yield {"first": a, "t_ns": times, "grid": grid, "shear": [rows_of(archive, s, a, b) for s in shears] if len(shears) == 2 else None}


def _flat(x: np.ndarray | None, n: int) -> pa.Array:
    if x is None:
        return pa.nulls(n, pa.list_(pa.float32()))
    flat = np.ascontiguousarray(x.reshape(n, -1), np.float32)
    return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, max(1, flat.shape[1]), dtype=np.int32) if flat.shape[1] else np.zeros(n + 1, np.int32), pa.array(flat.reshape(-1)))


def directories(paths: DataFrame, *, pads: Sequence[int] = PAD_IDS, rows: int = ROWS_PER_RANGE) -> DataFrame:
    """The ranges to read of archives (``path``): path, pad, first, last. A damaged archive has none."""
    wanted = tuple(pads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    with open_path(path) as file:
                        out += [(path, *r) for r in ranges_of(file, wanted, rows)]
                except (ValueError, EOFError, KeyError, zipfile.BadZipFile, NotImplementedError):
                    continue
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["path", "pad", "first", "last"])

    return paths.select("path").mapInArrow(run, RANGES)


def read_ranges(ranges: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """One row per sample of the given ranges, dealt out range by range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, pad, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                with open_path(path) as file:
                    for part in series_of(file, pad, first, last):
                        n = len(part["t_ns"])
                        h, w = part["grid"].shape[1:]
                        sx, sy = part["shear"] or (None, None)
                        cols = [pa.array([path] * n), pa.array(np.full(n, pad, np.int32)), pa.array(np.arange(part["first"], part["first"] + n)), pa.array(part["t_ns"]),
                                pa.array(np.full(n, h, np.int32)), pa.array(np.full(n, w, np.int32)), _flat(part["grid"], n), _flat(sx, n), _flat(sy, n)]
                        yield pa.RecordBatch.from_arrays(cols, TACTILE_SCHEMA.fieldNames())

    n = tasks or max(1, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n, "path", "pad", "first").mapInArrow(run, TACTILE_SCHEMA)


def read_npz_members(spark: SparkSession, root: str, pattern: str = "*_hand_data.npz", *, pads: Sequence[int] = PAD_IDS, rows: int = ROWS_PER_RANGE) -> DataFrame:
    """The wanted pads of all glove archives below a root, in stores that pyarrow can read (others: ``files.read_npz_tactile``).

    Spark lists the archives; tasks read their directories, then the ranges. Pads that are not wanted are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    d = read_ranges(directories(files, pads=pads, rows=rows))
    return d.withColumns({
        "recording_id": base_of(folder_of(F.col("path"))), "hand": F.regexp_extract(F.col("path"), r"(left|right)_hand_data\.npz$", 1),
    }).drop("path")


def write_archives(archives: DataFrame, root: str) -> DataFrame:
    """Write archives (relative ``path``, ``content``) below a root, each whole or not at all; gives the paths written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{base}/{path}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                part = f"{place}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, place)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    return archives.select("path", "content").mapInArrow(run, "path string")


def saved(arrays: dict[str, np.ndarray], compressed: bool = False) -> bytes:
    """An archive of arrays."""
    out = io.BytesIO()
    (np.savez_compressed if compressed else np.savez)(out, **arrays)
    return out.getvalue()
