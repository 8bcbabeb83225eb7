"""Mixing sources to target weights by Pareto order sampling.

Sources, in code point order with null last, have the weights 3, 1, 2, repeating, and share 150 % of
all words; a target stops at twice its source's words and what is left over is shared again. Within
a source, every document is due a number of copies that falls slowly with its length and never
passes two. Its whole copies are certain. What remains of it is an inclusion probability p: the
document draws a uniform u from a hash of itself, and documents are ranked by the odds of u divided
by the odds of p. The sample is the longest head of this order whose words do not pass what the target
still lacks; the one later document whose size comes nearest to the gap follows.

No task sorts a source: ranks are cut into fine buckets whose words are summed first, and only the
bucket that holds the cut is sorted. Null text or one without words has size 0 and takes nothing.
Repeated rows count as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajq.llm.common import stored
from trajq.plans.lineage import single

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: How copies fall with length: by 2 ** -TILT when the length doubles.
TILT = 0.25
#: Buckets of rank for each doubling of the odds.
FINE = 128


def sized(docs: DataFrame) -> DataFrame:
    """The slim rows that all decisions need: source key, size, length class, uniform u, tie-breaking key.

    Rows that are alike in doc_id, source and text are counted and numbered, whatever their partition.
    """
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), source_key().alias("source_key"), words.alias("size"), F.xxhash64("text").alias("mark"))
    alike = rows.groupBy("doc_id", "source_key", "size", "mark").agg(F.count("*").cast("int").alias("n"))
    return drawn(alike.select("doc_id", "source_key", "size", "mark", F.explode(F.sequence(F.lit(1), "n")).alias("number")))


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("z"))


def drawn(rows: DataFrame) -> DataFrame:
    key = F.xxhash64("doc_id", "mark", "number", F.lit(20_240_117))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "mark", "number", F.lit(6)), 12).cast("double") + 0.5) / float(1 << 52)
    octave = F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double")) + 1e-9).cast("int")
    return rows.select("*", octave.alias("octave"), u.alias("u"), key.alias("key"))


def water_level(rows: DataFrame, by: list[str], total: str, cap: str, weight: str, name: str) -> DataFrame:
    """Per ``by`` the level at which sum(min(cap, level * weight)) is the total; null where every row is at its cap."""
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up = order.orderBy(F.col(cap) / F.col(weight), weight).rowsBetween(Window.unboundedPreceding, -1)
    down = order.orderBy(F.col(cap) / F.col(weight), weight).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    tried = rows.withColumn("_level", (F.col(total) - F.coalesce(F.sum(cap).over(up), F.lit(0.0))) / F.sum(weight).over(down))
    fits = F.when(F.col("_level") * F.col(weight) <= F.col(cap) * (1 - 1e-12), F.col("_level"))
    return tried.groupBy(*by).agg(F.max(fits).alias(name))


def targets(rows: DataFrame) -> DataFrame:
    """Per source: its words and the target; a row per source."""
    sums = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("source_key")) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")))
    whole = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    weighed = weighed.select("*", (F.col("source_size") * MOST).alias("cap"), (whole * SHARE).alias("total"))
    level = water_level(weighed, [], "total", "cap", "weight", "level")
    target = F.least("cap", F.coalesce(single(level)["level"] * F.col("weight"), F.col("cap")))
    return weighed.select("source_key", "source_size", target.alias("target"))


def copies(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source and length class: the copies that a document is due, from sums over the class."""
    classes = rows.groupBy("source_key", "octave").agg(F.sum("size").cast("double").alias("words")).join(goals, "source_key")
    pull = F.pow(F.lit(2.0), F.lit(-TILT) * F.col("octave"))
    classes = classes.withColumn("pull", pull).withColumn("cap", F.col("words") * MOST).withColumn("weight", F.col("words") * F.col("pull"))
    level = water_level(classes.where("words > 0"), ["source_key"], "target", "cap", "weight", "level")
    due = F.least(F.lit(MOST), F.coalesce(F.col("level") * F.col("pull"), F.lit(MOST)))
    due = F.when(F.col("source_size") > 0, due).otherwise(0.0)
    return classes.join(level, "source_key", "left").select("source_key", "octave", "source_size", "target", due.alias("due"))


def ranked(rows: DataFrame, due: DataFrame) -> DataFrame:
    """Certain copies, and the Pareto rank of documents that may get one more."""
    p = F.col("due") - F.col("certain")
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    out = rows.join(due, ["source_key", "octave"]).withColumn("certain", F.floor(F.col("due") + 1e-12)).withColumn("p", F.greatest(p, F.lit(0.0)))
    out = out.withColumn("rank", F.when((F.col("p") > 1e-12) & (F.col("size") > 0), odds))
    return out.withColumn("bucket", F.floor(F.log2("rank") * FINE).cast("int"))


def cuts(rows: DataFrame) -> DataFrame:
    """Per source the last (bucket, rank, key) of the sample, and the row that fills the gap to the target best."""
    lacks = rows.groupBy("source_key").agg((F.first("target") - F.sum(F.col("size") * F.col("certain"))).alias("lack"))
    buckets = rows.where("rank is not null").groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket"))
    edge = buckets.withColumn("upto", upto).join(lacks, "source_key")
    edge = edge.where("upto >= lack").groupBy("source_key").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "lack")).alias("e")).select("source_key", "e.*")
    within = rows.join(edge, ["source_key", "bucket"]).where("rank is not null")
    run = F.sum("size").over(Window.partitionBy("source_key").orderBy("rank", "key")) + F.col("before")
    last = within.withColumn("upto", run).where("upto <= lack").groupBy("source_key").agg(F.max(F.struct("rank", "key", "upto")).alias("l"))
    gap = F.col("lack") - F.coalesce("l.upto", "before")
    cut = edge.join(last, "source_key", "left").select("source_key", F.col("bucket").alias("cut_bucket"), F.col("l.rank").alias("cut_rank"), F.col("l.key").alias("cut_key"), gap.alias("gap"))
    rest = rows.where("rank is not null").join(cut, "source_key").withColumn("miss", F.abs(F.col("size") - F.col("gap")))
    fill = rest.where(~head() & (F.col("miss") < F.col("gap"))).groupBy("source_key").agg(F.min(F.struct("miss", "rank", "key")).alias("f"))
    return cut.join(fill, "source_key", "left").select("source_key", "cut_bucket", "cut_rank", "cut_key", F.col("f.rank").alias("fill_rank"), F.col("f.key").alias("fill_key"))


def head() -> Column:
    """Whether a ranked row beside its source's cut belongs to the head of the order."""
    at = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("key") <= F.col("cut_key")))
    return (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & F.coalesce(at, F.lit(False)))


def taken() -> Column:
    """Copies of a ranked row beside its source's cut; a source without a cut takes every ranked row."""
    fills = F.coalesce((F.col("rank") == F.col("fill_rank")) & (F.col("key") == F.col("fill_key")), F.lit(False))
    more = F.col("rank").isNotNull() & (F.col("cut_bucket").isNull() | head() | fills)
    return F.col("certain") + F.coalesce(more, F.lit(False)).cast("long")


def decisions(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = stored(sized(docs), "sized")
    due = stored(copies(rows, targets(rows)), "copies")
    ranks = ranked(rows, due)
    return ranks, due, stored(cuts(ranks), "cuts")


def plan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, words taken, copies."""
    ranks, _, cut = decisions(docs)
    return ranks.join(cut, "source_key", "left").select("doc_id", "size", "source_size", "target", (F.col("size") * taken()).alias("taken"), taken().alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs, all its columns, as often as it is taken; repeated rows fare alike."""
    _, due, cut = decisions(docs)
    names = docs.columns
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    row = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("source_key"), words.alias("size"), F.xxhash64("text").alias("mark"), F.lit(1).alias("number"))
    ranks = ranked(drawn(row), due).join(cut, "source_key", "left")
    return ranks.select("row", F.explode(F.array_repeat(F.lit(0), taken().cast("int")))).select("row.*")
