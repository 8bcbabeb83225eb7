"""Runs (maximal periodic stretches) of the words of each document.

A run is a stretch of consecutive words with smallest period q that is at least ``max(least, 2 * q)``
words long and that no neighbouring word extends with period q. For every q the stretch holds two
neighbouring points i, i + q of the grid 0, q, 2q, ..., so all runs are found by asking, for every such
pair (n * ln n of them in all), how far the words agree forwards from it and backwards from it.

The longest common extension of two places is read off a difference cover modulo 7: from any two
places a step of at most six words reaches two covered places, so at most six words are compared
directly; from there a range minimum over the sorted covered suffixes gives the rest. Only covered
suffixes (3 of 7) are sorted, and only for texts in which a pair agrees over enough words to be in a run.

Nothing is shuffled: a document is one row. Null texts have no words, a null doc_id is kept; very long
texts take memory in proportion to words * log(words), grid pairs are made in blocks; repeated rows
each give their own result; ties among runs are settled as stated; columns besides doc_id and text
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.llm.common import slices

#: Fewest words of a run.
LEAST = 12
#: A difference cover: every difference modulo PERIOD is one of two members'.
PERIOD, COVER = 7, (1, 2, 4)
#: Grid pairs that are looked at at once.
BLOCK = 1 << 19


def cover_steps() -> np.ndarray:
    """steps[a, b]: the fewest words from places a and b (modulo PERIOD) on that lead to two covered places."""
    inside = [x in COVER for x in range(PERIOD)]
    return np.array([[next(s for s in range(PERIOD) if inside[(a + s) % PERIOD] and inside[(b + s) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)], np.int64)


STEPS = cover_steps()


def dense(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    """Ranks from 0 by an order and the flags of those that differ from the one before."""
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(differs) - 1
    return rank


class Extensions:
    """Longest common extensions between places of a word sequence (numbers from 0)."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.words = np.concatenate([words.astype(np.int64), np.full(2 * PERIOD, -1)])  # the end differs from every word
        places = [np.arange(r, n, PERIOD) for r in COVER]
        self.places = np.concatenate(places)
        self.index = np.full(n + 2 * PERIOD, -1, np.int64)
        self.index[self.places] = np.arange(len(self.places))
        #: Covered places one period on from each; the place beyond the end stands for nothing left.
        m = len(self.places)
        self.ahead = np.append(self.index[self.places + PERIOD], m)
        self.ahead[self.ahead < 0] = m
        if m:
            self.sort(m)

    def sort(self, m: int) -> None:
        """Ranks of the covered suffixes by doubling, their neighbours' common lengths, and the minima of ranges."""
        tuples = [self.words[self.places + k] for k in range(PERIOD)]
        order = np.lexsort(tuples[::-1])
        differs = np.ones(m, bool)
        differs[1:] = np.logical_or.reduce([t[order[1:]] != t[order[:-1]] for t in tuples])
        levels, jumps, ahead = [np.append(dense(order, differs), -1)], [], self.ahead
        while levels[-1][:-1].max() < m - 1:
            high, low = levels[-1][:-1].astype(np.int64), levels[-1][ahead[:-1]].astype(np.int64)
            key = high * (m + 1) + low + 1
            order = np.argsort(key, kind="stable")
            differs[1:] = key[order[1:]] != key[order[:-1]]
            jumps.append(ahead)
            levels.append(np.append(dense(order, differs), -1))
            ahead = ahead[ahead]
        self.rank = levels[-1][:-1].astype(np.int64)
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, m - 1), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            same = (levels[k][a] == levels[k][b]) & (a < m) & (b < m)
            common[same] += PERIOD << k
            step = jumps[k] if k < len(jumps) else None
            if step is not None:
                a[same], b[same] = step[a[same]], step[b[same]]
        common += self.compared(self.place(a), self.place(b), np.full(len(a), PERIOD))
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def place(self, index: np.ndarray) -> np.ndarray:
        return np.append(self.places, self.n)[index]

    def compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from a and b on, at most ``most`` (at most PERIOD), compared one by one."""
        got, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(PERIOD):
            live = live[(most[live] > k) & (a[live] != b[live])]
            live = live[(self.words[a[live] + k] == self.words[b[live] + k]) & (np.maximum(a[live], b[live]) + k < self.n)]
            if not len(live):
                break
            got[live] += 1
        return got

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from places a and b (a != b, at most n) on."""
        most = STEPS[a % PERIOD, b % PERIOD]
        got = self.compared(a, b, most)
        on = np.flatnonzero((got == most) & (np.maximum(a, b) + most < self.n))
        if len(on):
            x, y = self.rank[self.index[a[on] + most[on]]], self.rank[self.index[b[on] + most[on]]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            best = np.empty(len(on), np.int64)
            for k in np.unique(level).tolist():
                at = level == k
                best[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
            got[on] += best
        return got


def grid(n: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place) of every two neighbouring grid points place, place + period below n, in blocks of about ``block``."""
    q = 1
    while 2 * q <= n:
        most = max(1, block * q // n)
        periods = np.arange(q, min(n // 2, q + most - 1) + 1)
        counts = (n - 1) // periods
        total = int(counts.sum())
        period = np.repeat(periods, counts)
        yield period, (np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        q = int(periods[-1]) + 1


def find_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, smallest period) of all runs, by start, then period. ``words``: a number for each word."""
    n = len(words)
    found, forward, backward = [], None, None
    if n < max(least, 2):
        return np.zeros((0, 3), np.int64)
    ext = np.concatenate([np.full(3, -1), words, np.full(3, -1)])
    sure = least // 2  # so many places in a row agree with those a period on, the grid point among them
    for period, place in grid(n):
        keep = words[place] == words[place + period]
        period, place = period[keep], place[keep]
        if sure >= 6 and len(place):
            ahead, behind = np.ones(len(place), bool), np.ones(len(place), bool)
            at, to = place + 3, place + period + 3
            for k in (1, 2):
                ahead &= (ext[at + k] == ext[to + k]) & (ext[to + k] >= 0)
            for k in (1, 2, 3):
                behind &= (ext[at - k] == ext[to - k]) & (ext[at - k] >= 0)
            period, place = period[ahead | behind], place[ahead | behind]
        if not len(place):
            continue
        if forward is None:
            forward, backward = Extensions(words), Extensions(words[::-1])
        after = forward.common(place, place + period)
        before = backward.common(n - place, n - place - period)
        length = before + period + after
        long = length >= np.maximum(least, 2 * period)
        found.append(np.stack([(place - before)[long], length[long], period[long]], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(rows), bool)  # a stretch has its smallest period; its multiples found it too
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Flags of the words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def split(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and the controls from tab to carriage return."""
    return (text or "").encode().split()


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and each run's start, length and smallest period, counted in words from 0. A document without runs has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            per = [find_runs(numbered(split(t)), least) for t in batch.column(1).to_pylist()]
            rows = np.concatenate([np.zeros((0, 3), np.int64), *per])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(per)), [len(x) for x in per]))), *(pa.array(rows[:, k]) for k in range(3))], ["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and the words of each text, joined by one space, without what its runs repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for words in map(split, batch.column(1).to_pylist()):
                keep = kept_words(len(words), find_runs(numbered(words), least))
                out.append(b" ".join(w for w, k in zip(words, keep.tolist()) if k).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")


def woven(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic end where the key's checksum asks for one (one document in ten); a null key asks for none."""
    if key is None or not words:
        return words
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"


def digest(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] = woven, least: int = LEAST) -> DataFrame:
    """Per document: the number of runs, the longest (ties: smallest start, then period; nulls: none), checksums of all runs and of the words kept."""

    def row(key: int | None, text: str | None) -> tuple:
        words = edit(key, split(text))
        found = find_runs(numbered(words), least)
        keep = kept_words(len(words), found)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
        rest = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
        top = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist() if len(found) else [None] * 3
        milli = 1000 * top[1] // top[2] if len(found) else None
        return (key, len(found), *top, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(rest)).hexdigest(), len(words), len(rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in COLUMNS.split(", ")]
        for batch in slices(batches):
            rows = [row(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)
