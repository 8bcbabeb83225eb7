"""Near-duplicate documents by HyperMinHash: banded compressed registers, corrected estimates, exact checks.

A document is the set of its distinct five-word shingles (A-Z as a-z, words as runs of anything but
space and tab to carriage return; fewer words: the whole sequence), as 64-bit hashes. The hash range
is cut into 128 buckets; a register keeps, of its bucket's smallest hash, the leading-zero count and
ten mantissa bits. Equal sets are one node from the start.

1. Four registers make a band. All nodes that share a band are set beside the smallest of them only,
   so a bucket of any size yields one row per member.
2. The registers estimate the similarity of such a pair, corrected for chance collisions; pairs five
   standard errors below the threshold are dropped, so are sizes that rule it out.
3. What is left is confirmed on the full sets, the likeliest pair of each node first, the others only
   if they still lie in different components.
4. What bands leave apart meets on full sets: shingles are ordered from the rarest on, and two sets
   at the threshold have one in common among the first quarter of each, with enough left behind it in
   both (prefix and position filtering, exact). A passage that many documents share is frequent, so it
   stands at the end and brings none together that are not alike. The members of a shingle are met
   in rounds of stars, estimated and confirmed.

Two documents at the threshold of 0.75 share no band with a probability of 5e-6, at 0.8 of 5e-8.
Null text counts as empty; a document without words is linked with nothing. Rows that share a doc_id
are one document. A null doc_id is linked with nothing and kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.llm.common import Words, mapped, mix, shingles, slices, stored
from trajq.llm.components import components
from trajq.plans.lineage import SMALL_ROWS, measured

#: Similarity in hundredths.
LEAST = 75
BUCKET_BITS, MANTISSA = 7, 10
REGISTERS, ROWS = 1 << BUCKET_BITS, 4
BANDS = REGISTERS // ROWS
#: Standard errors that an estimate may lie below the threshold.
MARGIN = 5.0
#: Buckets of the table of shingle frequencies: a byte each, so its size is fixed. Any table gives the same links.
FREQUENCIES = 1 << 20


def sets_of(texts: list[str], words: Words) -> list[np.ndarray]:
    hashes, bounds = words.of_texts([t.encode() for t in texts])
    return [np.unique(shingles(hashes[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 128 registers per set: (leading zeros + 1) << 10 | mantissa, 0 where the bucket is empty."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(every):
        return out
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = (every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(doc * REGISTERS + bucket, prepend=-1))  # sets are sorted: the smallest hash of a bucket
    rest = (every[first] << np.uint64(BUCKET_BITS)) | np.uint64((1 << BUCKET_BITS) - 1)
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out[doc[first], bucket[first]] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of n and m shingles agree."""
    edge = 2.0 ** -np.arange(0, 33)
    a, b = ((1 - edge[None, 1:]) ** x - (1 - edge[None, :-1]) ** x for x in (n[:, None] / REGISTERS, m[:, None] / REGISTERS))
    return (a * b).sum(1) / (1 << MANTISSA)


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of register rows, and whether the pair may reach the threshold."""
    used = ((a > 0) | (b > 0)).sum(1)
    c = chance(n, m)
    estimate = np.clip((((a == b) & (a > 0)).sum(1) / np.maximum(used, 1) - c) / (1 - c), 0, 1)
    t = LEAST / 100
    sizes = 100 * np.minimum(n, m) >= LEAST * np.maximum(n, m)
    return estimate, sizes & (estimate + MARGIN * np.sqrt(t * (1 - t) / np.maximum(used, 1)) >= t)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the set), registers of every row. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            sets = sets_of(batch.column(1).to_pylist(), words)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            regs = [r.tobytes() for r in registers(sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "set_key", "registers"])

    return stored(mapped(plain(docs), run, "doc_id long, n_shingles long, set_key binary, registers binary"), "sketches")


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_keys(bands: np.ndarray) -> np.ndarray:
    """The key of each band of register rows (four registers as one number)."""
    return mix(mix(bands) ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def bands(nodes: DataFrame) -> DataFrame:
    """(band key, node) of every band with a filled register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                regs = np.ascontiguousarray(matrix(part.column(1))).view(np.uint64)
                keys = band_keys(regs)
                node = np.broadcast_to(part.column(0).to_numpy()[:, None], keys.shape)
                full = regs > 0
                yield pa.RecordBatch.from_arrays([pa.array(keys[full]), pa.array(node[full])], ["key", "node"])

    return mapped(nodes.select("node", "registers"), run, "key long, node long")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may reach the threshold, with their estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            estimate, ok = likely(matrix(batch.column(3)), matrix(batch.column(5)), n, m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimate)], ["a", "b", "estimate"]).filter(pa.array(ok))

    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")) for x in ("a", "b")]
    full = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "r_a", "n_b", "r_b")
    return mapped(full, run, "a long, b long, estimate double").groupBy("a", "b").agg(F.max("estimate").alias("estimate"))


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, hashes) of the documents that are asked for; no text moves while their ids count few. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            sets = [s.tobytes() for s in sets_of(batch.column(1).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    wanted = plain(docs).join(measured(ids.select(F.col("node").alias("doc_id")).distinct()), "doc_id").select("doc_id", "text")
    return stored(mapped(wanted, run, "node long, hashes binary").distinct(), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= LEAST * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    sides = [sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h_{x}")) for x in ("a", "b")]
    return mapped(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "h_a", "h_b"), run, "a long, b long")


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    for x in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")), x, "left").withColumn(f"c_{x}", F.coalesce(f"c_{x}", x))
    return pairs.where("c_a <> c_b").drop("c_a", "c_b")


def unresolved(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(node) of the bands whose members other than the smallest lie in several components."""
    at = placed(members.where("node <> head"), comps)
    split = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return at.join(split.select("key"), "key").select("node").distinct()


def placed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


def frequencies(sets: DataFrame) -> bytes:
    """One byte per bucket of shingle hashes, larger the more shingles of all sets fall into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCIES, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                every = np.frombuffer(b"".join(batch.column(0).slice(at, 1024).to_pylist()), np.uint64)
                total += np.bincount(slot(every), minlength=FREQUENCIES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["slot", "n"])

    counts = mapped(sets.select("hashes"), run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.select("slot", F.least(F.lit(255), F.round(F.log2("n") * 6)).cast("short").alias("level")).toArrow()
    out = np.zeros(FREQUENCIES, np.uint8)
    out[found["slot"].to_numpy()] = found["level"].to_numpy()
    return out.tobytes()


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FREQUENCIES.bit_length() + 1)).astype(np.int64)


def prefixes(sets: DataFrame, levels: bytes) -> DataFrame:
    """(key, node, n, pos) of the shingles of each set that come first in the order of (frequency, hash).

    Of a set of n shingles n - ceil(0.75 n) + 1: two sets at the threshold have one of these in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes = part.column(1).to_pylist()
                n = np.array([len(h) // 8 for h in hashes], np.int64)
                every = np.frombuffer(b"".join(hashes), np.uint64)
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((every, level[slot(every)], doc))
                pos = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
                keep = pos <= np.repeat(n + -LEAST * n // 100, n)
                doc = doc[keep]
                yield pa.RecordBatch.from_arrays([pa.array(every[order][keep].view(np.int64)), pa.array(part.column(0).to_numpy()[doc]), pa.array(n[doc].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], ["key", "node", "n", "pos"])

    return mapped(sets.select("node", "hashes"), run, "key long, node long, n int, pos int")


def searched(rows: DataFrame, comps: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``comps`` with every link among the sets of ``rows`` (prefixes).

    In each round some members of every key that spans several components are met by all others of
    it, unless the sizes or what is left behind their places in both orders is too little for the
    threshold; then they leave the key. The members met at once grow sixteenfold a round, so a key
    that stays open ends after a logarithmic number of rounds.
    """
    most = 8
    while True:
        at = placed(rows, comps)
        split = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        open_ = stored(at.join(split.select("key"), "key").select("key", "node", "n", "pos", "component"), "open")
        if open_.isEmpty():
            return comps
        heads = open_.groupBy("key", F.pmod(F.xxhash64("node", F.lit(most)), F.lit(most)).alias("part")).agg(F.min(F.struct("node", "n", "pos", "component")).alias("h")).select("key", "h.*")
        x, y = open_.alias("x"), heads.alias("y")
        sizes = (100 * F.least("x.n", "y.n") >= LEAST * F.greatest("x.n", "y.n")) & ((100 + LEAST) * F.least(F.expr("x.n - x.pos"), F.expr("y.n - y.pos")) >= LEAST * (F.col("x.n") + F.col("y.n")))
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & sizes)
        pairs = met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
        pairs = measured(estimated(pairs, nodes).select("a", "b"))
        ends = measured(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct())
        links = stored(confirmed(pairs, sets.join(ends, "node", "left_semi")), "edges")  # the other sets stay where they are
        comps = extended(comps, links)
        rows = open_.drop("component").join(heads.drop("component"), ["key", "node", "n", "pos"], "left_anti")
        most *= 16


def extended(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after more edges: only these, between components as they are, are solved.

    Few components are solved again with the edges, which takes no join and so no broadcast from the driver.
    """
    more = edges.count()
    if not more:
        return comps
    if more + comps.count() <= SMALL_ROWS:
        return components(edges.select("a", "b").unionAll(comps.select("node", "component")))
    for x in ("a", "b"):
        edges = placed(edges.withColumnRenamed(x, "node"), comps).drop("node").withColumnRenamed("component", x)
    up = components(edges)
    lone = up.join(comps.select("node"), "node", "left_anti")
    moved = comps.join(up.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return stored(moved.unionByName(lone), "components")


def clusters(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    rows = sketched(docs)
    known = rows.where("doc_id is not null and n_shingles > 0")
    nodes = stored(known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "nodes")
    keyed = bands(nodes)
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("m")).where("m > 1").drop("m")
    members = stored(keyed.join(heads, "key"), "bands")
    stars = members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    pairs = stored(estimated(stars, nodes), "pairs")
    sets = full_sets(docs, pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")))
    best = pairs.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("x")).select("a", "x.b")
    same_id = known.groupBy("doc_id", "set_key").count().join(nodes.select("set_key", "node"), "set_key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    same_id = same_id.join(known.groupBy("doc_id").agg(F.countDistinct("set_key").alias("k")).where("k > 1").select(F.col("doc_id").alias("a")), "a")
    edges = stored(confirmed(best, sets).unionAll(same_id), "edges")
    comps = components(edges)
    more = stored(confirmed(apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), comps), sets), "edges")
    comps = extended(comps, more)
    left = stored(unresolved(members, comps), "left")
    if not left.isEmpty():
        sets = full_sets(docs, left)
        comps = searched(prefixes(sets, frequencies(sets)), comps, nodes, sets)
    of_set = nodes.select("set_key", "node").join(comps, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    found = rows.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows, all columns, of one document of each component; of rows with one doc_id one stays."""
    found = stored(clusters(docs), "clusters")
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(measured(gone), "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    return left if again else left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id"]))
