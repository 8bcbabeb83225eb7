"""Toxicity by a small convolutional text classifier, trained in numpy, block by block.

A word (run of letters, digits and non-ASCII characters, A-Z as a-z) has a row in each of two hashed
embedding tables, its embedding is the smaller value of the two in each coordinate, so a word that
shares a row of one table with a telling word does not look like it. Filters of
several widths slide over the words, their largest response over the whole text is kept, and a
logistic output reads these. One coordinate of each table starts at the log odds of the row's words
between the classes; everything is then trained together (Adam, gradients through the maxima only).

All labelled documents that may be learned from are used. Each epoch is a Spark job: every block of them is
gone through from the model of the epoch before, and the changes are averaged over the blocks, those of
a row of a table over the blocks that touched it. The changes are summed as integers, so their order is
indifferent. The odds are counts of all these documents, and the thresholds for rejecting, exact over all
their scores, are calibrated by language; the language is no input of the score. Null text counts as empty and scores as a text without words. Without labels of both
classes every score is 0 (or 1, where only label 1 is known). Repeated rows are scored each on its
own; other columns are kept by ``kept`` and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.llm import labelled
from trajq.llm.common import SMALL_BYTES, Words, mapped, slices
from trajq.plans.lineage import checkpoint, measured
from trajq.plans.ordered import global_index, running_sum

ROWS, DIMS, WIDTHS, FILTERS = 1 << 17, 6, (1, 2, 3), 8
EPOCHS, BATCH = 3, 64
#: Words that a batch of texts is cut at, a longer text stands alone; parts of one that changes are summed in.
BATCH_WORDS, UNIT = 1 << 18, 2.0**40
#: Rows of sums that a worker sends at once.
SENT = 1 << 14
#: Labelled documents of each class that a language needs for a threshold of its own.
LEAST = 30
PAD = max(WIDTHS) - 1


def word_rows(texts: list[str], words: Words) -> list[np.ndarray]:
    """Two table rows per word, each text followed by padding (row ROWS)."""
    hashes, bounds = words.of_texts([t.encode() for t in texts])
    rows = np.stack([hashes & np.uint64(ROWS - 1), hashes >> np.uint64(40) & np.uint64(ROWS - 1)], 1).astype(np.int32)
    pad = np.full((PAD, 2), ROWS, np.int32)
    return [np.concatenate([rows[a:b], pad]) for a, b in zip(bounds[:-1], bounds[1:])]


def sample_features(texts: list[str], words: Words | None = None) -> list[np.ndarray]:
    return word_rows(texts, words or Words(letters=True))


@dataclass
class Model:
    tables: list[np.ndarray]
    filters: list[np.ndarray]  # by width: (width, DIMS, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    thresholds: dict = field(default_factory=dict)
    threshold: float = 0.5
    constant: float | None = None

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.tables[0][rows[:, 0]], self.tables[1][rows[:, 1]])

    def responses(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """By width, the response of each filter at each place; places that reach into the next text never win."""
        out = []
        for w, b in zip(self.filters, self.biases):
            z = np.full((len(x), FILTERS), -1e9, np.float32)
            n = len(x) - len(w) + 1
            z[:n] = x[:n] @ w[0] + b
            for j in range(1, len(w)):
                z[:n] += x[j : n + j] @ w[j]
            for j in range(1, len(w)):
                z[starts + sizes - j] = -1e9
            out.append(z)
        return out

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        z = self.responses(self.embed(np.concatenate(texts)), starts, sizes)
        return np.maximum(np.concatenate([np.maximum.reduceat(r, starts, axis=0) for r in z], axis=1), 0) @ self.out + self.bias

    def score_rows(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(np.float64), -50, 50)))


@dataclass
class State:
    """The model and what its next step depends on: Adam's moments of all but the tables, Adagrad's sums of these."""

    model: Model
    moments: list[np.ndarray]
    speed: list[np.ndarray]
    step: int = 0

    def dense(self) -> list[np.ndarray]:
        return [*self.model.filters, *self.model.biases, self.model.out, self.model.bias]

    def copy(self) -> State:
        m = self.model
        model = Model([t.copy() for t in m.tables], [f.copy() for f in m.filters], [b.copy() for b in m.biases], m.out.copy(), m.bias.copy())
        return State(model, [v.copy() for v in self.moments], [v.copy() for v in self.speed], self.step)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1).astype(np.float64) for x in [*self.dense(), *self.moments]])


def sent(sums: np.ndarray, at: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The entries ``at`` of (table, row) sums, SENT at once."""
    flat = sums.reshape(-1, sums.shape[2])
    for i in range(0, len(at), SENT):
        k, row = np.divmod(at[i : i + SENT], sums.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(row.astype(np.int32)), *(pa.array(v) for v in flat[at[i : i + SENT]].T)], names)


def word_counts(rows: DataFrame) -> list[np.ndarray]:
    """Documents of each label that hold a word of each table row, over all labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, ROWS + 1, 2), np.int64)
        for _, raw, y in labelled.blocks(batches):
            for x, label in zip(raw, y):
                for k, column in enumerate(np.frombuffer(x, np.int32).reshape(-1, 2).T):
                    seen[k, np.unique(column), label] += 1
        yield from sent(seen, np.flatnonzero(seen.sum(2)), ["k", "row", "n0", "n1"])

    found = mapped(rows, run, "k int, row int, n0 long, n1 long").groupBy("k", "row").agg(F.sum("n0"), F.sum("n1")).toArrow()
    k, row, *n = (np.asarray(c) for c in found.columns)
    out = [np.zeros((2, ROWS + 1)) for _ in range(2)]
    for t, seen in enumerate(out):
        for label in range(2):
            seen[label, row[k == t]] = n[label][k == t]
    return out


def start(rows: DataFrame, n0: int, n1: int) -> State:
    rng = np.random.default_rng(5)
    tables = []
    for seen in word_counts(rows):
        odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        total = seen.sum(0)
        table = rng.normal(0, 0.05, (ROWS + 1, DIMS)).astype(np.float32)
        table[:, 0] = odds * total / (total + 20)
        table[ROWS] = 0
        tables.append(table)
    filters, biases = [], []
    for w in WIDTHS:
        f = rng.normal(0, 0.1, (w, DIMS, FILTERS))
        f[:, 0] = rng.uniform(0.4, 0.8, (w, FILTERS))
        filters.append(f.astype(np.float32))
        biases.append(np.full(FILTERS, -1.0, np.float32))
    n = FILTERS * len(WIDTHS)
    state = State(Model(tables, filters, biases, rng.uniform(0.05, 0.2, n).astype(np.float32), np.full(1, -1.0, np.float32)), [], [])
    state.moments = [np.zeros_like(p) for p in state.dense() for _ in range(2)]
    state.speed = [np.full(len(t), 1e-1, np.float32) for t in tables]
    return state


def cuts(sizes: np.ndarray, most: int) -> list[slice]:
    """Runs of at most ``most`` texts and about BATCH_WORDS words."""
    out, at, words = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (i - at == most or words + n > BATCH_WORDS):
            out.append(slice(at, i))
            at, words = i, 0
        words += n
    return [*out, slice(at, len(sizes))] if len(sizes) else out


def train(state: State, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, rate: float = 0.01) -> list[np.ndarray]:
    """One epoch over the texts, which changes the state; the rows of each table that it touched."""
    model = state.model
    order, seen = rng.permutation(len(texts)), [np.zeros(ROWS + 1, bool) for _ in model.tables]
    for run in cuts(np.array([len(texts[i]) for i in order]), BATCH):
        pick = order[run]
        rows = np.concatenate([texts[i] for i in pick])
        sizes = np.array([len(texts[i]) for i in pick])
        starts = np.cumsum(sizes) - sizes
        x = model.embed(rows)
        z = model.responses(x, starts, sizes)
        best = [np.stack([s + r[s : s + n].argmax(0) for s, n in zip(starts, sizes)]) for r in z]
        pooled = [np.take_along_axis(r, b, 0) for r, b in zip(z, best)]
        hidden = np.maximum(np.concatenate(pooled, 1), 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.bias, -30, 30)))
        d = ((p - y[pick]) * weight[y[pick]] / len(pick)).astype(np.float32)
        back = d[:, None] * model.out[None] * (hidden > 0)
        grads_f, grads_b, touched = [], [], []
        for k, (w, b) in enumerate(zip(model.filters, best)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            gf = np.zeros_like(w)
            for j in range(len(w)):
                inputs = x[b + j]  # (texts, filters, DIMS)
                gf[j] = np.einsum("tf,tfe->ef", g, inputs)
                touched.append(((b + j).reshape(-1), (g[:, :, None] * w[j].T[None]).reshape(-1, DIMS)))
            grads_f.append(gf)
            grads_b.append(g.sum(0))
        state.step += 1
        for param, grad, m, v in zip(state.dense(), [*grads_f, *grads_b, hidden.T @ d, d.sum(keepdims=True)], state.moments[::2], state.moments[1::2]):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**state.step)) / (np.sqrt(v / (1 - 0.99**state.step)) + 1e-8)
        where = np.concatenate([t for t, _ in touched])
        change = np.concatenate([c for _, c in touched])
        values = [table[rows[where, k]] for k, table in enumerate(model.tables)]
        for k, table in enumerate(model.tables):
            row, part = rows[where, k], change * (values[k] <= values[1 - k])
            keep = row != ROWS
            np.add.at(state.speed[k], row[keep], (part[keep] ** 2).mean(1))
            np.add.at(table, row[keep], -rate * part[keep] / np.sqrt(state.speed[k][row[keep]])[:, None])
            seen[k][row[keep]] = True
    return [np.flatnonzero(s) for s in seen]


def epoch(rows: DataFrame, state: State, weight: np.ndarray, number: int) -> State:
    """The state after every block was trained on from ``state`` and the changes were averaged."""
    names = ["k", "row", "n", *(f"d{i}" for i in range(DIMS + 1))]
    dense = len(WIDTHS) - 1  # the key of what is no row of tables 0 and 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, ROWS + 1, DIMS + 2), np.int64)
        flat, n, base, step = 0, 0, state.flat(), state.step
        for (block, part), raw, y in labelled.blocks(batches):
            own = state.copy()
            touched = train(own, [np.frombuffer(r, np.int32).reshape(-1, 2) for r in raw], y, weight, np.random.default_rng([6, number, block, part]))
            for k, at in enumerate(touched):
                change = np.column_stack([own.model.tables[k][at] - state.model.tables[k][at], own.speed[k][at] - state.speed[k][at]])
                sums[k, at, 0] += 1
                sums[k, at, 1:] += np.rint(change.astype(np.float64) * UNIT).astype(np.int64)
            flat, n, step = flat + np.rint((own.flat() - base) * UNIT).astype(np.int64), n + 1, max(step, own.step)
        if n:
            yield from sent(sums, np.flatnonzero(sums[:, :, 0]), names)
            m = np.zeros((len(flat) + 1, DIMS + 2), np.int64)
            m[:, 0], m[:-1, 1], m[-1, 1] = n, flat, step - state.step
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), dense, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), *(pa.array(v) for v in m.T)], names)

    schema = "k int, row int, " + ", ".join(f"{c} long" for c in names[2:])
    # the last entry of what is no table row is the number of steps, of which the largest counts
    sums = mapped(rows, run, schema).groupBy("k", "row").agg(*(F.sum(c).alias(c) for c in names[2:]), F.max("d0").cast("double").alias("top"))
    mean = [(F.col(c).cast("double") / UNIT / F.col("n")).cast("float").alias(c) for c in names[3:]]  # what the driver adds, no wider
    found = sums.select("k", "row", *mean, "top").toArrow()
    columns = {c: np.asarray(found.column(c)) for c in found.column_names}
    out = state.copy()
    for k, (table, speed) in enumerate(zip(out.model.tables, out.speed)):
        own = columns["k"] == k
        at = columns["row"][own]
        for i in range(DIMS):
            table[at, i] += columns[f"d{i}"][own]
        speed[at] += columns[f"d{DIMS}"][own]
    own = columns["k"] == dense
    order = np.argsort(columns["row"][own])
    mean = columns["d0"][own][order]
    out.step = state.step + int(columns["top"][own][order][-1])
    at = 0
    for param in [*out.dense(), *out.moments]:
        param += mean[at : at + param.size].reshape(param.shape)
        at += param.size
    return out


def cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors, classes weighed alike; among equals the one nearest 0.5."""
    levels = np.unique(p)
    tries = np.concatenate([[0.5], (levels[:-1] + levels[1:]) / 2])
    hit, miss = np.sort(p[y == 1]), np.sort(p[y == 0])
    wrong = np.searchsorted(hit, tries) / max(1, len(hit)) + 1 - np.searchsorted(miss, tries) / max(1, len(miss))
    return float(min(zip(np.round(wrong, 9), np.abs(tries - 0.5), tries))[2])


def thresholds(scores: DataFrame) -> dict[str, float]:
    """``cut`` of all rows (lang, y, p) under "", and of each language with LEAST rows of either label under its name.

    Equal scores are counted, the running counts of a language are taken bucket by bucket of its levels' order.
    """
    of = F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("lang", F.lit("")))))
    levels = checkpoint(scores.select(of.alias("g"), "p", "y").groupBy("g", "p").agg(F.sum(1 - F.col("y")).alias("m"), F.sum("y").alias("h")))
    totals = levels.groupBy("g").agg(F.sum("h").alias("hs"), F.sum("m").alias("ms"), *(F.sum(F.when(F.col("p") < 0.5, F.col(c)).otherwise(0)).alias(f"{c}_half") for c in "hm"))
    totals = measured(totals.where((F.col("g") == "") | (F.least("hs", "ms") >= LEAST)))
    at = global_index(levels, ["g", "p"], "i")
    at = checkpoint(running_sum(at, ["g"], "i", {"hc": F.col("h"), "mc": F.col("m")}))
    follow = at.select("g", (F.col("i") - 1).alias("i"), F.col("p").alias("next"))
    t = (F.col("p") + F.col("next")) / 2
    below = lambda c: F.col(f"{c}c") - F.when(t <= F.col("p"), F.col(c)).otherwise(0)
    tries = at.join(follow, ["g", "i"]).select("g", t.alias("t"), below("h").alias("hb"), below("m").alias("mb")).join(totals.select("g", "hs", "ms"), "g")
    tries = tries.unionByName(totals.select("g", F.lit(0.5).alias("t"), F.col("h_half").alias("hb"), F.col("m_half").alias("mb"), "hs", "ms"))
    wrong = F.col("hb") / F.greatest(F.lit(1), "hs") + 1 - F.col("mb") / F.greatest(F.lit(1), "ms")
    best = tries.groupBy("g").agg(F.min(F.struct(F.bround(wrong, 9), F.abs(F.col("t") - 0.5), F.col("t").alias("t")))["t"].alias("t"))
    return {r["g"]: r["t"] for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", of: int = 5, held: int = 0, epochs: int = EPOCHS) -> Model:
    words = Words(letters=True)
    rows = labelled.gathered(docs, labelled.training(labels, label, of, held), partial(sample_features, words=words))
    counts = labelled.classes(rows)
    if len(counts) < 2:
        return Model([], [], [], np.zeros(0), np.zeros(1), constant=float(next(iter(counts), 0)))
    state = start(rows, counts[0], counts[1])
    weight = np.array([0.5 * sum(counts.values()) / counts[y] for y in (0, 1)])
    for number in range(epochs):
        state = epoch(rows, state, weight, number)
    model = state.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", SMALL_BYTES):
            p = model.score_rows([np.frombuffer(x, np.int32).reshape(-1, 2) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["lang", "y", "p"])

    found = thresholds(mapped(rows.select("lang", "y", "x"), run, "lang string, y int, p double"))
    model.threshold = found.pop("")
    model.thresholds = found
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""
    def run(texts: list[str]) -> np.ndarray:
        return model.score_rows(word_rows(texts, words)) if texts else np.zeros(0)

    words = Words(letters=True)
    return labelled.scored(docs, run)


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all their columns, whose score stays below the threshold of their language."""
    words = Words(letters=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_BYTES):
            p = model.score_rows(word_rows([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], words))
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
            limit = np.array([model.thresholds.get(x, model.threshold) for x in langs])
            yield batch.filter(pa.array(p < limit))

    return mapped(docs, run, docs.schema)
