"""Token ids as binary files: frequency-ranked ids in variable-length bytes with separate control bytes.

The most frequent id becomes 0. A rank takes one to four little-endian bytes; two bits of a control
byte say how many, four ranks to a control byte. Control and data bytes stand apart, so a block is
decoded by numpy table lookups. A folder holds ``part-*.ids`` files, in ascending doc_id order by
name, and ``ranks.u32`` (the id of each rank).

Null text counts as empty, a null doc_id comes first, repeated doc_ids are ordered by a checksum of
their ids, an empty table gives no file, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajq.llm.common import open_file, shared_folder, slices, stored, write_file
from trajq.llm.tokenization import Encoder

MAGIC = b"RKIDv1\0\0"
#: Ids in a file; a longer document has a file of its own size.
FILE_IDS = 4_000_000
BLOCK = 1 << 20

LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.int64)
TOTALS = LENGTHS.sum(axis=1)
OFFSETS = np.cumsum(LENGTHS, axis=1) - LENGTHS


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 ranks."""
    ranks = ranks.astype("<u4")
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    quads = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    quads[: len(code)] = code
    control = quads[0::4] | quads[1::4] << 2 | quads[2::4] << 4 | quads[3::4] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first n ranks that the control and data bytes hold."""
    out = np.empty(len(control) * 4, np.uint32)
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    at = 0
    for a in range(0, len(control), BLOCK // 4):
        c = control[a : a + BLOCK // 4]
        ends = np.cumsum(TOTALS[c])
        first = (at + ends - TOTALS[c])[:, None] + OFFSETS[c]
        size = LENGTHS[c]
        value = data[first].astype(np.uint32)
        for b in range(1, int(size.max(initial=1))):
            value |= np.where(size > b, data[first + b].astype(np.uint32) << np.uint32(8 * b), np.uint32(0))
        out[a * 4 : (a + len(c)) * 4] = value.reshape(-1)
        at += int(ends[-1])
    return out[:n]


def file_bytes(doc_ids: list, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    head = np.array([len(doc_ids), len(ranks), len(control), len(data)], "<u8").tobytes()
    return b"".join([MAGIC, head, ids.tobytes(), known.tobytes(), sizes.astype("<u8").tobytes(), control, data])


def read_file(path: str) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids per document and all ranks of a file."""
    with open_file(path) as f:
        raw = np.frombuffer(f.read(), np.uint8)
    if raw[:8].tobytes() != MAGIC:
        raise ValueError(f"{path} is no file of token ids")
    docs, n, controls, size = raw[8:40].view("<u8").tolist()
    cuts = np.cumsum([40, 8 * docs, docs, 8 * docs, controls, size])
    parts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    ids, known = np.frombuffer(parts[0].tobytes(), "<i8"), parts[1]
    return [int(i) if k else None for i, k in zip(ids, known)], np.frombuffer(parts[2].tobytes(), "<u8").astype(np.int64), decode_ranks(parts[3], parts[4], n)


def tokenized(docs: DataFrame, tokenizer: str, end: int, vocabulary: int) -> DataFrame:
    """One row per document with its ids, packed, and one row (n = -1) per task with its counts of ids. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = Encoder(tokenizer, end), np.zeros(vocabulary, np.int64)
        for batch in slices(batches):
            keys = batch.column(0).to_pylist()
            rows: list[tuple] = []
            found = encoder.ids([x or "" for x in batch.column(1).to_pylist()])
            counts += np.bincount(np.concatenate(found), minlength=vocabulary)
            for key, ids in zip(keys, found):
                planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T  # equal places of the ids together
                rows.append((key, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), pa.compress(planes.tobytes(), codec="zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n", "crc", "data"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([pa.compress(counts.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["doc_id", "n", "crc", "data"])

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, crc long, data binary"), "token-ids")


def ranking(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """The ids by descending count, ties to the smaller id; one number per id of the vocabulary reaches the driver."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.frombuffer(pa.decompress(data, decompressed_size=8 * vocabulary, codec="zstd"), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in encoded.where("n = -1").select("data").mapInArrow(unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return np.argsort(-counts, kind="stable").astype(np.uint32)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int, vocabulary: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode all texts into files of the folder; returns the stored list of files (part, number, file, docs, ids, before)."""
    encoded = tokenized(docs, tokenizer, end, vocabulary)
    by_rank = ranking(encoded, vocabulary)
    write_file(folder, "ranks.u32", by_rank.astype("<u4").tobytes())
    rank = np.empty(vocabulary, np.uint32)
    rank[by_rank] = np.arange(vocabulary, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        ranks: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, held
            name = f"part-{part:07d}-{number:05d}.ids"
            write_file(folder, name, file_bytes(keys, np.array([len(r) for r in ranks]), np.concatenate(ranks)))
            row = pa.RecordBatch.from_pylist([{"part": part, "number": number, "file": name, "docs": len(keys), "ids": held, "before": before}])
            number, before, held = number + 1, before + held, 0
            keys.clear()
            ranks.clear()
            return row

        for batch in batches:
            for key, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
                keys.append(key)
                ranks.append(rank[np.ascontiguousarray(planes.T).view("<u4").reshape(-1)])
                held += n
                if held >= file_ids:
                    yield flush()
        if keys:
            yield flush()

    ordered = encoded.where("n >= 0").repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc").select("doc_id", "n", "data")
    return stored(ordered.mapInArrow(run, "part long, number long, file string, docs long, ids long, before long"), "token-files")


def read_ids(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))  # one row per partition of the writer
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    jobs = files.join(first, "part").select("file", (F.col("base") + F.col("before")).alias("start")).repartition(max(1, files.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = None
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                if by_rank is None:
                    with open_file(f"{folder}/ranks.u32") as f:
                        by_rank = np.frombuffer(f.read(), "<u4")
                keys, sizes, ranks = read_file(f"{folder}/{name}")
                ids = by_rank[ranks].astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64()), pa.array([name] * len(keys))], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    return jobs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def round_trip(docs: DataFrame, tokenizer: str, end: int, vocabulary: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts to a new shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "ids")
    return read_ids(folder, write_ids(docs, folder, tokenizer, end, vocabulary, file_ids))
