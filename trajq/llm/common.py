"""Storage, batching and hashing shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from trajq.plans.lineage import scratch_dir

#: Bytes of text that one numpy step works on; SMALL_BYTES where a step makes many rows of numbers or strings of it.
SLICE_BYTES, SMALL_BYTES = 2 << 20, 1 << 19
#: Bytes of an Arrow batch that Spark hands a worker; by default it collects 10,000 rows or 64 MB outside the heap for each task.
BATCH_BYTES = 2 << 20
#: Bytes that separate words: space and the ASCII controls from tab to carriage return.
SPACES = (9, 10, 11, 12, 13, 32)


def stored(df: DataFrame, name: str = "llm") -> DataFrame:
    """The table written to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of about BATCH_BYTES; the session keeps that setting, which is read when the rows are asked for."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, with its file system spelled out for readers outside Spark."""
    path = scratch_dir(spark, name)
    if ":" not in path.split("/")[0]:
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + path
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def write_file(folder: str, name: str, data: bytes) -> None:
    """A whole file or nothing: written under a name of its own, then renamed, so a repeated task is harmless."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    try:
        store.move(part, f"{root}/{name}")
    except OSError:  # a store that does not replace on a move: an earlier attempt wrote the same bytes
        if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
            raise
        store.delete_file(part)


def open_file(path: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    return store.open_input_file(root)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (a longer text stands alone).

    Memory that Arrow holds back for later batches is returned before each, since workers outlive their tasks.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.zeros(batch.num_rows, np.int64) if batch.num_rows == 0 else np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        at, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Hashes of the words of many texts at once.

    A word's hash is a polynomial over random 64-bit values of its bytes, read off a running sum,
    so the cost does not depend on the number of words. ``lower``: A-Z count as a-z.
    ``letters``: words are runs of ASCII letters, digits and non-ASCII bytes instead of runs between spaces.
    """

    BASE = 0x9E3779B97F4A7C15
    BLOCK = 1 << 20

    def __init__(self, lower: bool = True, letters: bool = False, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            self.value[65:91] = self.value[97:123]
        self.inside = np.ones(256, bool)
        if letters:
            self.inside[:128] = [chr(i).isalnum() for i in range(128)]
        else:
            self.inside[list(SPACES)] = False
        self.powers(self.BLOCK)

    def powers(self, n: int) -> None:
        for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __getstate__(self) -> dict:
        """Without the powers, 16 MB that would be broadcast with every function that uses the words."""
        return {k: v for k, v in self.__dict__.items() if k not in ("up", "down")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.powers(self.BLOCK)

    def block(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(buf) > len(self.up):
            self.powers(len(buf))
        inside = self.inside[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        if len(inside) and inside[-1]:
            edge = np.concatenate([edge, [len(buf)]])
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.value[buf] * self.up[: len(buf)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start]), start.astype(np.int64)

    def hashes(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word of a buffer, in blocks that end between words."""
        out, at = [], 0
        while at < len(buf):
            end = min(len(buf), at + self.BLOCK)
            while end < len(buf):
                back = np.flatnonzero(~self.inside[buf[at:end]])
                if len(back):
                    end = at + int(back[-1]) + 1
                    break
                end = min(len(buf), end + self.BLOCK)
            h, s = self.block(buf[at:end])
            out.append((h, s + at))
            at = end
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate([h for h, _ in out]), np.concatenate([s for _, s in out])

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, and for each text the range [bounds[i], bounds[i + 1]) of its words."""
        ends = np.cumsum([0] + [len(t) + 1 for t in texts])
        hashes, start = self.hashes(np.frombuffer(b" ".join(texts) + b" ", np.uint8)) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return hashes, np.searchsorted(start, ends)


#: Fixed odd multipliers of the five places of a shingle.
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words: the whole sequence as one; none: none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < size:
        return mix(np.array([(words * PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = words[: n - size + 1] * PLACES[0]
    for i in range(1, size):
        total += words[i : n - size + 1 + i] * PLACES[i % len(PLACES)]
    return mix(total)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]
