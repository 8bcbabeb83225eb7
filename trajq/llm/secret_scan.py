"""Secret scan: three fixed patterns, and strings whose sliding-window entropy is that of random keys.

A candidate is a run of 20 or more key characters. For each character class, a window slides over
the stretches of the candidate in that class; its Shannon entropy follows from counts of which one
goes up and one down at each step. Windows at or above the threshold of the class join into a span,
unless an allow-list names the candidate as harmless. A placeholder acquits the stretch that it is part
of; standing alone between separators it only cuts the stretch in two. Of a span, what fixed patterns
do not cover is reported, in as many parts as are left.

Spans are (start, end, kind) in code points, end exclusive. Null text counts as empty and has none;
repeated rows are scanned each on its own; ``redacted`` keeps all other columns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.llm.common import mapped, slices

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_CANDIDATE = 12, 18, 16, 20
#: What a window holds.
WINDOW = 20
#: Character classes and the entropy in bits that a window of each needs; random keys lie above, words below.
CLASSES = (
    (re.compile(r"[0-9a-f]+|[0-9A-F]+"), 3.0),
    (re.compile(r"[A-Za-z0-9]+"), 3.6),
    (re.compile(r"[A-Za-z0-9+/=_-]+"), 3.9),
)
#: Candidates that are no secrets: UUIDs, paths and hyphenated words.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"([A-Za-z]+|[0-9]+)([/_=+-]+([A-Za-z]+|[0-9]+))*[/_=+-]*"),
)
#: Runs of one alphabet in order and placeholders: no part of a secret's stretch.
PLACEHOLDER = re.compile(r"0123456789|abcdefghij|ABCDEFGHIJ|EXAMPLE|example|xxxxxx|XXXXXX")
ALONE = re.compile(r"(?<![A-Za-z0-9])(?:0123456789|abcdefghij|ABCDEFGHIJ|EXAMPLE|example|x{6,}|X{6,})(?![A-Za-z0-9])")
BYTES_KEY = np.array([bool(re.fullmatch(r"[A-Za-z0-9+/=_-]", chr(i))) for i in range(256)]) & (np.arange(256) < 128)
BYTES_HEX = np.array([chr(i) in "0123456789abcdef" for i in range(256)])


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def random_windows(text: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Joined ranges of the windows whose entropy is at least ``least`` and that hold letters and two digits."""
    if len(text) < window:
        return
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, digits, begin, end = 0.0, 0, -1, -1
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        digits += c.isdigit()
        if i >= window:
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += term[n - 1] - term[n]
            digits -= old.isdigit()
        if i >= window - 1 and 2 <= digits < window and math.log2(window) - total / window >= least - 1e-9:
            if begin >= 0 and i - window + 1 <= end:
                end = i + 1
            else:
                if begin >= 0:
                    yield begin, end
                begin, end = i - window + 1, i + 1
    if begin >= 0:
        yield begin, end


def entropy_spans(candidate: str, at: int, allowed: tuple = ALLOWED) -> list[Span]:
    if any(a.fullmatch(candidate) for a in allowed):
        return []
    found: list[tuple[int, int]] = []
    cuts = [x for m in ALONE.finditer(candidate) for x in m.span()]
    for begin, stop in zip([0, *cuts[1::2]], [*cuts[::2], len(candidate)]):
        for chars, least in CLASSES:
            for m in chars.finditer(candidate, begin, stop):
                if not PLACEHOLDER.search(m.group()):
                    found += [(at + m.start() + a, at + m.start() + b) for a, b in random_windows(m.group(), WINDOW, least)]
    joined: list[list[int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return [Span(a, b, "entropy") for a, b in joined]


def outside(span: Span, covered: list[Span]) -> list[Span]:
    """The parts of a span that no other, sorted by start, covers."""
    parts, at = [], span.start
    for c in covered:
        if c.end > at and c.start < span.end:
            if c.start > at:
                parts.append(Span(at, c.start, span.kind))
            at = c.end
    return parts + [Span(at, span.end, span.kind)] if at < span.end else parts


def runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def find(texts: list[str], allowed: tuple = ALLOWED) -> list[list[Span]]:
    """All spans of each text, sorted by start, then kind as listed."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    found: list[list[Span]] = [[] for _ in texts]
    candidates: list[list[tuple[int, int]]] = [[] for _ in texts]
    for inside, least, kind in ((BYTES_HEX, LEAST_HEX, "hex"), (BYTES_KEY, LEAST_CANDIDATE, "")):
        start, end = runs(inside[buf], least)
        doc = np.searchsorted(ends, start, side="right")
        for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist()):
            first = int(ends[d]) - len(raw[d]) - 1
            before = a - first if len(raw[d]) == len(texts[d]) else len(raw[d][: a - first].decode())
            (found[d].append(Span(before, before + b - a, kind)) if kind else candidates[d].append((before, before + b - a)))
    for d, (text, r) in enumerate(zip(texts, raw)):
        low = r.lower()
        if any(n in low for n in NAMES):
            found[d] += [Span(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
        if b"AKIA" in r:
            found[d] += [Span(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        if candidates[d]:
            covered = sorted(found[d])
            for a, b in candidates[d]:
                found[d] += [part for s in entropy_spans(text[a:b], a, allowed) for part in outside(s, covered)]
        if len(found[d]) > 1:
            found[d].sort(key=lambda s: (s.start, KINDS.index(s.kind)))
    return found


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: counts of each kind, the checksum of the fixed kinds' spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = find(batch.column(1).to_pylist())
            counts = [pa.array([sum(s.kind == k for s in x) for x in spans], pa.int64()) for k in KINDS]
            base = [hashlib.sha256(spelled([s for s in x if s.kind != "entropy"]).encode()).hexdigest() for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts[:3], pa.array(base, pa.string()), pa.array([spelled(x) for x in spans], pa.string()), counts[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return mapped(texts, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, each found span of ``text`` replaced by the mark; ``n_chars`` is kept true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            texts = batch.column(names.index("text")).to_pylist()
            new = [t if t is None else redact(t, s, mark) for t, s in zip(texts, find([t or "" for t in texts]))]
            cols = list(batch.columns)
            cols[names.index("text")] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in names:
                lengths = [n if old == t else len(t) for n, old, t in zip(batch.column(names.index("n_chars")).to_pylist(), texts, new)]
                cols[names.index("n_chars")] = pa.array(lengths, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return mapped(docs, run, docs.schema)
