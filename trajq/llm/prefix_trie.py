"""The prefix trie of conversations, by truncation peeling.

Conversations are sequences of turns; every distinct beginning of d turns is a node of depth d. The trie is
peeled from its greatest depth: the nodes that survive from the level below meet the conversations that end
here, whatever shares its first d turns becomes one node, its sums are closed, its last turn is stripped,
and it goes on to depth d - 1. Nodes are found and summed in the same descent.

So that no level is a shuffle and no node a hot key, sequences are dealt out in lexicographic order (equal
ones first collapse into one row and a digest of their ids), and every task peels its own stretch of that
order. A node lies open only if it holds the first or the last sequence of a stretch, as only those may go
on in another; such partial nodes, at most two paths a task, merge by key and are peeled once more. Their
number depends on tasks and depth, not on the number of conversations.

Rows without conv_id take no part; null role or text counts as empty; null turns come first, equal turns of a
conversation are ordered by role, then by the hash of the turn, and a repeated row is a turn of its own; a text
of any length is one 20-byte item (16 of its SHA-256, 4 of its length), so a long conversation is one row of
20 bytes a turn; columns besides conv_id, turn, role and text are not read; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.llm.common import stored
from trajq.plans.lineage import measured

#: Bytes of a turn's item: 16 of the hash, 4 of the length of its text.
ITEM = 20
#: Ids of equal conversations are joined in groups of 2 ** CHUNK_BITS consecutive ids before they are dealt out.
CHUNK_BITS = 9
NO_ENDS = hashlib.sha256(b"").hexdigest()

PEELED = "key binary, parent binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved long, size long, ends string"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and its turns' items (hexadecimal) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.lpad(F.hex(F.octet_length(text)), 8, "0")
    item = F.concat(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32), size)
    turn = F.col("turn").cast("long")
    row = F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"), item.alias("item"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row")).where(F.col("conv_id").isNotNull())
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["item"]).alias("items"))


def rebuilt(seqs: DataFrame, of: int = 5, most: int = 9) -> DataFrame:
    """Each conversation with its first h turns taken from conversation c - c % of, h = crc32(c) % most.

    All turns there if it has fewer, none if it is absent. A donor serves at most ``of`` conversations.
    """
    heads = seqs.where(F.col("conv_id") % of == 0).select(F.col("conv_id").alias("donor"), F.slice("items", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = seqs.select("conv_id", "items", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % of).alias("donor")).join(heads, "donor", "left")
    none = F.array().cast("array<string>")
    own = F.slice("items", F.col("h") + 1, F.greatest(F.size("items") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), own).alias("items"))


def chained(key: bytes) -> list[bytes]:
    """The identity of each beginning of a sequence, by depth."""
    out = [b"\0" * 16]
    for at in range(0, len(key), ITEM):
        out.append(hashlib.sha256(out[-1] + key[at : at + ITEM]).digest()[:16])
    return out


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // ITEM
    if a[: high * ITEM] == b[: high * ITEM]:
        return high
    step = 1
    while low + step < high and a[low * ITEM : (low + step) * ITEM] == b[low * ITEM : (low + step) * ITEM]:
        low, step = low + step, step * 2
    high = min(high, low + step)
    while high - low > 1:  # agree up to low, differ at high
        mid = (low + high) // 2
        if a[low * ITEM : mid * ITEM] == b[low * ITEM : mid * ITEM]:
            low = mid
        else:
            high = mid
    return low


def folded(batches: Iterator[pa.RecordBatch]) -> tuple[list[bytes], list[int], list[int], list[str]]:
    """Distinct sequences with their number of conversations, smallest id and digest of ids; rows come sorted by (key, chunk)."""
    keys: list[bytes] = []
    counts, lows, ends = [], [], []
    digest = None
    for batch in batches:
        for key, n, low, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "n", "low", "ids"))):
            if keys and keys[-1] == key:
                counts[-1] += n
                lows[-1] = min(lows[-1], low)
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                ends.append(digest.hexdigest())
            digest = hashlib.sha256(ids.encode())
            keys.append(key), counts.append(n), lows.append(low)
    if digest is not None:
        ends.append(digest.hexdigest())
    return keys, counts, lows, ends


FIELDS = ("start", "low", "n", "children", "leaves", "saved", "size", "ended", "open")


def peel(keys: list[bytes], counts: list[int], lows: list[int], ends: list[str]) -> Iterator[dict[str, list]]:
    """The nodes of a sorted stretch of distinct sequences, level by level from the deepest; columns as in PEELED.

    A closed node carries its parent's conv_id, or the parent's key if the parent is open. An open one carries
    its key and sums over closed children only.
    """
    m = len(keys)
    depth_of = np.array([len(k) // ITEM for k in keys], np.int64)
    common = np.array([-1] + [shared(a, b) for a, b in zip(keys, keys[1:])], np.int64)
    first, last = chained(keys[0]), chained(keys[-1])
    by_depth = np.argsort(depth_of, kind="stable")
    bounds = np.searchsorted(depth_of[by_depth], np.arange(int(depth_of.max()) + 2))
    counts_, lows_ = np.array(counts, np.int64), np.array(lows, np.int64)
    nodes = {f: np.zeros(0, np.int64) for f in FIELDS}
    for d in range(int(depth_of.max()), -1, -1):
        new = np.sort(by_depth[bounds[d] : bounds[d + 1]])
        k = len(nodes["start"])
        item = {f: np.concatenate([nodes[f], np.zeros(len(new), np.int64)]) for f in FIELDS}
        item["start"][k:], item["low"][k:], item["n"][k:], item["ended"][k:] = new, lows_[new], counts_[new], new + 1
        survivor = np.arange(k + len(new)) < k
        order = np.argsort(item["start"], kind="stable")
        item, survivor = {f: x[order] for f, x in item.items()}, survivor[order]
        begins = common[item["start"]] < d
        at, group = np.flatnonzero(begins), np.cumsum(begins) - 1
        closed = survivor & (item["open"] == 0)
        add = lambda x: np.add.reduceat(np.where(closed, x, 0), at)
        start, n = item["start"][at], np.add.reduceat(item["n"], at)
        up = {"start": start, "low": np.minimum.reduceat(item["low"], at), "n": n, "children": add(1), "leaves": add(item["leaves"]), "saved": add(item["saved"])}
        up["ended"] = np.add.reduceat(np.where(survivor, 0, item["ended"]), at)
        up["size"] = np.array([int.from_bytes(keys[i][ITEM * d - 4 : ITEM * d], "big") for i in start.tolist()] if d else [0] * len(start), np.int64)
        is_first, is_last = start == 0, np.zeros(len(start), bool)
        is_last[-1] = depth_of[-1] >= d and (d == 0 or common[start[-1] + 1 :].min(initial=d) >= d)
        up["open"] = (is_first | is_last).astype(np.int64)
        shut = up["open"] == 0
        up["leaves"][shut & (up["children"] == 0)] = 1
        up["saved"][shut] += ((n - 1) * up["size"])[shut]
        yield emitted(item, closed, d + 1, group, up, first, last, ends)
        if up["open"].any():
            yield opened(up, d, first, last, ends)
        nodes = up


def emitted(item: dict, which: np.ndarray, depth: int, group: np.ndarray, up: dict, first: list[bytes], last: list[bytes], ends: list[str]) -> dict[str, list]:
    """The closed nodes of a level, now that their parents are known."""
    rows = np.flatnonzero(which)
    above = group[rows]
    is_open = up["open"][above] == 1
    keyed = [None if not o else first[depth - 1] if s == 0 else last[depth - 1] for o, s in zip(is_open.tolist(), up["start"][above].tolist())]
    parent = [None if o else p for o, p in zip(is_open.tolist(), up["low"][above].tolist())]
    got = {f: item[f][rows].tolist() for f in ("low", "n", "children", "leaves", "saved", "size", "ended")}
    return {"key": [None] * len(rows), "parent": keyed, "parent_conv_id": parent, "conv_id": got["low"], "depth": [depth] * len(rows), "n_convs": got["n"], "n_children": got["children"],
            "n_leaves": got["leaves"], "saved": got["saved"], "size": got["size"], "ends": [ends[e - 1] if e else NO_ENDS for e in got["ended"]]}


def opened(up: dict, d: int, first: list[bytes], last: list[bytes], ends: list[str]) -> dict[str, list]:
    """The open nodes of a level, with the sums of their closed children."""
    rows = np.flatnonzero(up["open"])
    got = {f: x[rows].tolist() for f, x in up.items()}
    path = [first if s == 0 else last for s in got["start"]]
    return {"key": [p[d] for p in path], "parent": [p[d - 1] if d else None for p in path], "parent_conv_id": [None] * len(rows), "conv_id": got["low"], "depth": [d] * len(rows), "n_convs": got["n"],
            "n_children": got["children"], "n_leaves": got["leaves"], "saved": got["saved"], "size": got["size"], "ends": [ends[e - 1] if e else None for e in got["ended"]]}


KINDS = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}


def batch_of(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], KINDS[k]) for c, k in fields], [c for c, _ in fields])


def peel_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = folded(batches)
    if parts[0]:
        yield from (batch_of(x, PEELED) for x in peel(*parts) if x["conv_id"])


def peel_spine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merged open nodes, which come deepest first: children's sums go up, then parents' ids come down."""
    rows = [r for b in batches for r in b.to_pylist()]
    above: dict[bytes, list[int]] = {}
    for r in rows:
        children, leaves, saved = above.pop(r["key"], (0, 0, 0))
        r["n_children"] += children
        r["n_leaves"] += leaves if r["n_children"] else 1
        r["saved"] += saved + (r["n_convs"] - 1) * r["size"]
        r["ends"] = r["ends"] or NO_ENDS
        if r["parent"] is not None:
            total = above.setdefault(r["parent"], [0, 0, 0])
            for k, x in enumerate((1, r["n_leaves"], r["saved"])):
                total[k] += x
    low = {r["key"]: r["conv_id"] for r in rows}
    for r in rows:
        r["parent_conv_id"] = low.get(r["parent"])
    if rows:
        yield batch_of({c: [r[c] for r in rows] for c in rows[0]}, PEELED)


def trie(seqs: DataFrame, partitions: int | None = None) -> DataFrame:
    """All nodes of the conversations (conv_id, items): columns as in NODES.

    conv_id is the node's smallest member and parent_conv_id its parent's (null at the root), n_convs its members,
    saved_tokens the bytes that sharing its subtree's texts saves, ends_sha256 the digest of the members that end here.
    """
    parts = partitions or int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = seqs.select("conv_id", F.unhex(F.array_join("items", "")).alias("key"), F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
    ids: Column = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    copies = rows.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), ids.alias("ids"))
    ordered = copies.repartitionByRange(parts, "key").sortWithinPartitions("key", "chunk")
    peeled = stored(ordered.mapInArrow(peel_stretch, PEELED), "trie")
    merged = peeled.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.first("parent").alias("parent"), F.lit(None).cast("long").alias("parent_conv_id"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.first("size").alias("size"), F.max("ends").alias("ends"),
    )
    spine = measured(merged.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(peel_spine, PEELED))
    named = {"saved": "saved_tokens", "ends": "ends_sha256"}
    out = [F.col(c).alias(named.get(c, c)) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")]
    closed = peeled.where(F.col("key").isNull())
    under = closed.where(F.col("parent").isNotNull()).drop("parent_conv_id", "key").join(spine.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    return closed.where(F.col("parent").isNull()).select(*out).unionByName(under.select(*out)).unionByName(spine.select(*out))


def digest(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    return trie(rebuilt(stored(sequences(turns), "sequences")))
