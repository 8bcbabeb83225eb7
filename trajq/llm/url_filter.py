"""URL filters: rules first, then naive Bayes over the words that hosts and paths are made of.

Names in urls are words written together. A unigram model of the words of the pages' own text splits them:
Viterbi search finds the cheapest way to read a run of letters as known words and, at a higher cost that
grows with their length, unknown pieces. The segmented tokens of host and path, kept apart, are scored
by multinomial naive Bayes. It is trained on all pages that a rule decides, and judges those that none does.

Models are bounded: at most ``VOCABULARY`` words of at most ``LONGEST`` letters, the most frequent over all pages,
unknown pieces in ``BUCKETS`` classes, digits by how many there are; so at most 2 * (VOCABULARY + BUCKETS + 10)
tokens are counted by class. Pages are not shuffled; names that recur in a task are split once.

A null url or one without ``://`` has an empty host and path and, like a url none of whose tokens was seen in training,
stays allowed unless a rule says otherwise; so does everything if rules block nothing or allow nothing. Long urls are
split in time proportional to their length; repeated rows are judged each on its own, and weigh as often as they stand there;
equally cheap readings resolve to the one with the longer last word, equally long rules to the one listed first.
Columns besides page_id, url and html are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.llm.common import stored

VOCABULARY = 65_536
LONGEST = 24
BUCKETS = 4096
#: Names that a task remembers the reading of.
REMEMBERED = 50_000


class Rule(NamedTuple):
    """A host with all its subdomains, and what a path must start with."""

    host: str
    path: str
    verdict: str


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules[::-1], key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def located(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    host, path = parsed(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return rows.withColumn("m", matched(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("ruled"))


def unigrams(pages: DataFrame, column: str = "html", most: int = VOCABULARY, longest: int = LONGEST) -> dict[str, int]:
    """The most frequent words (lower-case letters) outside tags, with their counts over all pages.

    All words at least as frequent as a threshold 2 ** (k / 8), the lowest that at most ``most`` words pass. Only their
    numbers by k and, once the threshold is known, they themselves reach the driver.
    """
    text = F.lower(F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), "<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word")).where(F.length("word") <= longest)
    counted = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.floor(F.log2("n") * 8)), "words")
    least, total = None, 0
    for r in sorted(counted.groupBy("k").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += r["words"]
        if total > most:
            break
        least = r["k"]
    return {} if least is None else {r["word"]: r["n"] for r in counted.where(F.col("k") >= least).select("word", "n").collect()}


PARTS = re.compile(r"[^\W\d_]+|\d+")


class Segmenter:
    """Splits runs of letters into words by unigram Viterbi; digits are told apart by their number only."""

    def __init__(self, counts: dict[str, int], longest: int = LONGEST):
        total = math.log(max(1, sum(counts.values())))
        self.cost = {w: total - math.log(n) for w, n in counts.items()}
        #: An unknown piece costs ten times less probability for each letter more.
        self.unknown = [total + (k - 1) * math.log(10) for k in range(longest + 1)]
        self.longest = longest
        self.memory: dict[str, tuple[str, ...]] = {}

    def words(self, letters: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(letters) + 1):
            cost, at = math.inf, 0
            for start in range(max(0, end - self.longest), end):
                c = best[start] + self.cost.get(letters[start:end], self.unknown[end - start])
                if c < cost:
                    cost, at = c, start
            best.append(cost)
            back.append(at)
        out, end = [], len(letters)
        while end:
            out.append(letters[back[end] : end])
            end = back[end]
        return out[::-1]

    def pieces(self, name: str) -> tuple[str, ...]:
        """Words of a host or path in order; ``#3`` for three digits."""
        got = self.memory.get(name)
        if got is None:
            parts = (m.group() for m in PARTS.finditer(name.lower()))
            got = tuple(w for p in parts for w in ([f"#{min(len(p), 10)}"] if p[0].isdigit() else self.words(p)))
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[name] = got
        return got

    def token(self, word: str) -> str:
        return word if word in self.cost or word[0] == "#" else f"?{zlib.crc32(word.encode()) % BUCKETS}"

    def tokens(self, host: str, path: str) -> list[str]:
        """What naive Bayes counts: words of the host and of the path, kept apart."""
        return [f"{field}:{self.token(w)}" for field, name in (("host", host), ("path", path)) for w in self.pieces(name)]


class Bayes:
    """Log odds of ``block`` of each token; classes weigh the same beforehand, since rules don't sample the web."""

    def __init__(self, blocked: dict[str, int], allowed: dict[str, int]):
        seen = sorted(blocked.keys() | allowed.keys())
        nb, na = sum(blocked.values()) + len(seen), sum(allowed.values()) + len(seen)
        both = bool(blocked) and bool(allowed)
        self.odds = {t: math.log((blocked.get(t, 0) + 1) / nb) - math.log((allowed.get(t, 0) + 1) / na) for t in seen} if both else {}

    def score(self, tokens: list[str]) -> float:
        """The probability of ``block`` by the tokens seen in training; 0.5 without any."""
        x = math.fsum(self.odds.get(t, 0.0) for t in tokens)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def fit(rows: DataFrame, segmenter: Segmenter) -> Bayes:
    """From rows (host, path, ruled): token counts of all that a rule decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for host, path, ruled in zip(*(c.to_pylist() for c in batch.columns)):
                count.update((ruled, t) for t in segmenter.tokens(host, path))
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(count.values()), pa.int64())], ["ruled", "token", "n"])

    counted = rows.where(F.col("ruled").isNotNull()).select("host", "path", "ruled").mapInArrow(run, "ruled string, token string, n long")
    found: dict[str, dict[str, int]] = {"block": {}, "allow": {}}
    for r in counted.groupBy("ruled", "token").agg(F.sum("n").alias("n")).collect():
        found[r["ruled"]][r["token"]] = r["n"]
    return Bayes(found["block"], found["allow"])


JUDGED = "page_id long, host string, path string, rule string, verdict string, score double, host_words string, path_words string"


def judged(rows: DataFrame, segmenter: Segmenter, bayes: Bayes) -> DataFrame:
    """page_id, host, path, rule, verdict, the method's score and the words it read (joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, ruled = (batch.column(k).to_pylist() for k in (1, 2, 4))
            scores = [bayes.score(segmenter.tokens(h, p)) for h, p in zip(hosts, paths)]
            verdict = [r or ("block" if s > 0.5 else "allow") for r, s in zip(ruled, scores)]
            words = ([" ".join(segmenter.pieces(x)) for x in names] for names in (hosts, paths))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(verdict, pa.string()), pa.array(scores, pa.float64()), *(pa.array(w, pa.string()) for w in words)], [c.split()[0] for c in JUDGED.split(", ")])

    return rows.select("page_id", "host", "path", "rule", "ruled").mapInArrow(run, JUDGED)


def filtered(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every page's verdict: models fitted on all pages, then applied to all."""
    rows = located(pages, rules)
    segmenter = Segmenter(unigrams(pages))
    return judged(rows, segmenter, fit(rows, segmenter))
