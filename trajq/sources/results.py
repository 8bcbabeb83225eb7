"""Results of expensive work, kept across runs: finished keys are never worked on again."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajq.sources.storage import children, exists


class ResultStore:
    """Rows of results and an append-only ledger of the keys (recording, hand, model, rate, ...) they answer.

    A run writes its rows, then its ledger entries, each in a folder of its own, so readers see either
    nothing of a run or all of it. A run killed in between leaves rows without entries: ``recover`` adopts
    them if they are complete, so what was paid for is kept; a torn folder is ignored and its keys are done
    again. A key that two runs answered at once counts in the first of them only. A key without rows
    is finished too. Rows with an ``error`` are attempts: recorded, not results, and tried again.
    Null keys equal each other.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    def _runs(self, part: str) -> list[str]:
        """Runs whose folder of ``part`` was written to its end."""
        return [r for r in children(self.spark, f"{self.root}/{part}") if r.startswith("run=") and exists(self.spark, f"{self.root}/{part}/{r}/_SUCCESS")]

    def _read(self, part: str) -> DataFrame | None:
        runs = self._runs(part)
        if not runs:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{part}").option("mergeSchema", True).parquet(*[f"{self.root}/{part}/{r}" for r in runs])

    def _same(self, a: DataFrame, b: DataFrame, *more: str) -> Column:
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in (*self.keys, *more)])

    def ledger(self) -> DataFrame | None:
        """One entry per key and run: keys, ``run``, ``n_rows``, ``error`` (null for a finished key)."""
        return self._read("ledger")

    def finished(self) -> DataFrame | None:
        """Keys with the run that counts."""
        ledger = self.ledger()
        return None if ledger is None else ledger.where(F.col("error").isNull()).groupBy(*self.keys).agg(F.min("run").alias("run"))

    def todo(self, inputs: DataFrame, *, attempts: int | None = None) -> DataFrame:
        """Inputs whose key is not finished (nor has failed ``attempts`` times)."""
        ledger = self.ledger()
        if ledger is None:
            return inputs
        done = F.count(F.when(F.col("error").isNull(), 1)) > 0
        spent = F.count(F.when(F.col("error").isNotNull(), 1)) >= attempts if attempts else F.lit(False)
        gone = ledger.groupBy(*self.keys).agg((done | spent).alias("_gone")).where("_gone")
        return inputs.join(gone, self._same(inputs, gone), "left_anti")

    def record(self, inputs: DataFrame, results: DataFrame) -> str:
        """Append the results of some inputs: rows first, then an entry for each of their keys."""
        run = f"t{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        if "error" not in results.columns:
            results = results.withColumn("error", F.lit(None).cast("string"))
        results.write.parquet(f"{self.root}/rows/run={run}")
        self._enter(run, inputs)
        return run

    def _enter(self, run: str, inputs: DataFrame | None) -> None:
        rows = self.spark.read.parquet(f"{self.root}/rows/run={run}")
        per = rows.groupBy(*self.keys).agg(F.count("*").alias("n_rows"), F.max("error").alias("error"))
        if inputs is not None:
            asked = inputs.select(*self.keys).distinct()
            names = [asked[k] for k in self.keys]
            per = asked.join(per, self._same(asked, per), "left").select(*names, F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), "error")
        per.write.parquet(f"{self.root}/ledger/run={run}")

    def recover(self) -> list[str]:
        """Enter the keys of rows whose run ended before its entries were written; the runs adopted."""
        known = set(self._runs("ledger"))
        lost = [r[4:] for r in self._runs("rows") if r not in known and not exists(self.spark, f"{self.root}/ledger/{r}")]
        for run in lost:
            self._enter(run, None)
        return lost

    def run(self, inputs: DataFrame, work: Callable[[DataFrame], DataFrame], *, blocks: int = 1, attempts: int | None = None) -> DataFrame:
        """Do what is left and return all results of the store.

        ``work`` maps inputs to rows that carry their keys. The keys are dealt into ``blocks`` by hash and
        entered block by block: a run that dies loses at most the block it was in.
        """
        self.recover()
        for b in range(blocks):
            part = self.todo(inputs, attempts=attempts)
            if blocks > 1:
                part = part.where(F.pmod(F.xxhash64(*self.keys), F.lit(blocks)) == b)
            if not part.isEmpty():
                self.record(part, work(part))
        return self.rows()

    def rows(self) -> DataFrame:
        """Result rows of finished keys, each key from one run; with ``run``."""
        rows, finished = self._read("rows"), self.finished()
        if rows is None or finished is None:
            raise FileNotFoundError(f"no finished results in {self.root}")
        return rows.join(finished, self._same(rows, finished, "run"), "left_semi").where(F.col("error").isNull()).drop("error")
