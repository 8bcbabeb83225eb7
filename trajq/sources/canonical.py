"""Trajectory datasets and statistics files on disk."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajq.functions.layout import WIDTH
from trajq.operators.stats import column_entries, merge_moments, moment_rows, moment_stats
from trajq.operators.windows import EPISODES_PER_CHUNK, FPS, episode_offsets
from trajq.sources.storage import children, exists, put_once, read_text, remove

ROWS_PER_FILE = 1_000_000
FRAME_TYPES = {
    "observation.state": "array<float>", "action": "array<float>", "action_mask": "array<boolean>", "timestamp": "float",
    "frame_index": "bigint", "episode_index": "bigint", "index": "bigint", "task_index": "bigint",
}


MANIFEST = "_manifest.json"
STAGED = "_staged"


def _base(spark: SparkSession, root: str) -> str:
    """Where the tables of a dataset lie: the folder its manifest names, or the root of a dataset written elsewhere."""
    if not exists(spark, f"{root}/{MANIFEST}"):
        return root
    return f"{root}/{json.loads(read_text(spark, f'{root}/{MANIFEST}'))['base']}"


def write_canonical(
    frames: DataFrame, episodes: DataFrame, tasks: DataFrame, root: str, *, robot_type: str = "arm", sources: DataFrame | None = None, dropped: DataFrame | None = None, fps: float = FPS,
) -> None:
    """Write a dataset, all of it or nothing.

    ``data`` (zstd parquet by chunk) and under ``meta`` episodes, tasks, mergeable moments, statistics
    per episode and of the dataset, the map from source episodes (``sources``: episode_index,
    source_episode, source_episode_id), the report of kept and ``dropped`` (source_episode, reasons, ...) ones,
    and info. Everything goes to a staged folder; one small manifest, renamed into place last, makes it
    visible together. A writer that dies before leaves an unnamed folder (``remove_abandoned``), and the next
    one starts afresh. A dataset that exists is never overwritten.

    Rows are range-partitioned by (chunk, episode, frame): one very long episode spreads over
    many files, and the row-group ranges of ``episode_index`` let a reader skip the other episodes. The
    per-field description a parquet footer would carry is in the info file.
    """
    spark = frames.sparkSession
    taken = f"dataset already exists: {root}"
    if exists(spark, f"{root}/{MANIFEST}") or exists(spark, f"{root}/data"):
        raise FileExistsError(taken)
    if episodes.isEmpty():
        raise ValueError("no episodes left after validation")
    name = f"{STAGED}/{uuid.uuid4().hex}"
    base = f"{root}/{name}"
    wide = F.size("`observation.state`") != WIDTH
    checked = F.when(wide, F.raise_error(F.lit(f"state is not {WIDTH} wide"))).otherwise(F.col("`observation.state`"))
    out = frames.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in FRAME_TYPES.items()]).withColumn("observation.state", checked.cast("array<float>"))
    out = out.withColumn("chunk", F.floor(F.col("episode_index") / EPISODES_PER_CHUNK))
    out = out.repartitionByRange("chunk", "episode_index", "frame_index").sortWithinPartitions("chunk", "episode_index", "frame_index")
    out.write.partitionBy("chunk").option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{base}/data")
    episodes.write.json(f"{base}/meta/episodes")
    tasks.write.json(f"{base}/meta/tasks")
    # From the written files, so the frames are not computed twice; the totals come from the episodes' rows.
    written = spark.read.parquet(f"{base}/data").withColumn("_episode", F.col("episode_index"))
    moment_rows(column_entries(written, list(FRAME_TYPES), ["_episode"]), ["_episode"]).withColumnRenamed("_episode", "episode_index").write.parquet(f"{base}/meta/moments")
    moments = spark.read.parquet(f"{base}/meta/moments")
    _check_lengths(episodes, moments)
    moment_stats(moments).write.json(f"{base}/meta/episodes_stats")
    moment_stats(merge_moments(moments)).write.json(f"{base}/meta/norm_stats")
    if sources is None:
        sources = episodes.select("episode_index", F.col("episode_index").cast("string").alias("source_episode"), F.lit(None).cast("string").alias("source_episode_id"))
    mapped = sources.join(episodes.select("episode_index", "length"), "episode_index").select(
        F.col("episode_index").alias("output_episode_index"), F.col("source_episode").cast("string").alias("source_episode"), F.col("source_episode_id").cast("string").alias("source_episode_id"), "length")
    mapped.write.parquet(f"{base}/meta/source_episode_map")
    report = mapped.withColumn("kept", F.lit(True))
    if dropped is not None:
        report = report.unionByName(dropped.withColumn("kept", F.lit(False)), allowMissingColumns=True)
    report.write.parquet(f"{base}/meta/conversion_report")
    shape = {"array<float>": ("float32", WIDTH), "array<boolean>": ("bool", WIDTH), "float": ("float32", 1), "bigint": ("int64", 1)}
    features = F.to_json(F.create_map(*[x for c, t in FRAME_TYPES.items() for x in (F.lit(c), F.struct(F.lit(shape[t][0]).alias("dtype"), F.array(F.lit(shape[t][1])).alias("shape")))]))
    info = episodes.agg(
        F.count("*").alias("total_episodes"), F.sum("length").alias("total_frames"), F.lit(robot_type).alias("robot_type"),
        F.lit(EPISODES_PER_CHUNK).alias("chunks_size"), F.lit(fps).alias("fps"), F.concat(F.lit("0:"), F.count("*").cast("string")).alias("train"), features.alias("features"))
    info.coalesce(1).write.json(f"{base}/meta/info")
    if not put_once(spark, f"{root}/{MANIFEST}", json.dumps({"base": name, "tables": ["data", *(f"meta/{t}" for t in TABLES)]})):
        raise FileExistsError(taken)


#: Tables under ``meta`` of a dataset written here.
TABLES = ("episodes", "tasks", "moments", "episodes_stats", "norm_stats", "source_episode_map", "conversion_report", "info")


def _check_lengths(episodes: DataFrame, moments: DataFrame) -> None:
    """Raise unless every announced episode has as many frames as announced, and no other has any."""
    have = moments.where(F.col("column") == "frame_index").select("episode_index", F.col("count").alias("_have"))
    off = episodes.select("episode_index", "length").join(have, "episode_index", "full").where(~F.col("length").eqNullSafe(F.col("_have")) & ~((F.col("length") == 0) & F.col("_have").isNull()))
    found = off.orderBy("episode_index").limit(5).collect()
    if found:
        raise ValueError("episodes whose frames differ from their length: " + ", ".join(f"{r['episode_index']} ({r['_have']} of {r['length']})" for r in found))


def remove_abandoned(spark: SparkSession, root: str) -> list[str]:
    """Delete staged folders that the manifest does not name; call it while nobody writes."""
    base = _base(spark, root)
    gone = [n for n in children(spark, f"{root}/{STAGED}") if f"{root}/{STAGED}/{n}" != base]
    for n in gone:
        remove(spark, f"{root}/{STAGED}/{n}")
    return gone


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A metadata table in any of the accepted layouts: a folder or file of parquet or JSON lines."""
    folder = f"{root}/meta/{name}"
    if exists(spark, folder):
        nested = spark.read.option("recursiveFileLookup", True)
        if not nested.option("pathGlobFilter", "*.parquet").format("binaryFile").load(folder).select("path").isEmpty():
            return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
        return spark.read.option("recursiveFileLookup", True).json(folder)
    for reader, path in ((spark.read.json, f"{folder}.jsonl"), (spark.read.parquet, f"{folder}.parquet")):
        if exists(spark, path):
            return reader(path)
    raise FileNotFoundError(folder)


def read_canonical(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """``frames``, ``episodes`` (with row ranges), ``tasks`` and ``info`` of a dataset, and what else ``write_canonical`` gives.

    Frames may lie in one folder, in ``key=value`` folders or in nested folders of other names;
    metadata may be JSON lines or parquet, in a file or nested in a folder; info may span lines. The
    text of a task may be the unnamed index of its table. The frame count must equal the announced
    total, which is checked when ``info`` is read.
    """
    root = _base(spark, root)
    files = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).format("binaryFile").load(f"{root}/data").select("path")
    keyed = not files.where(F.col("path").rlike("/[^/=]+=[^/]*/[^/]*$")).isEmpty()
    frames = spark.read.option("recursiveFileLookup", not keyed).parquet(f"{root}/data")
    tasks = _table(spark, root, "tasks")
    if "task" not in tasks.columns and "__index_level_0__" in tasks.columns:
        tasks = tasks.withColumnRenamed("__index_level_0__", "task")
    info = spark.read.json(f"{root}/meta/info") if exists(spark, f"{root}/meta/info") else spark.read.option("multiLine", True).json(f"{root}/meta/info.json")
    info = info.withColumn("_n", frames.agg(F.count("*")).scalar())
    message = F.concat(F.lit("rows "), F.col("_n").cast("string"), F.lit(" differ from total_frames "), F.col("total_frames").cast("string"))
    info = info.withColumn("total_frames", F.when(F.col("_n") != F.col("total_frames"), F.raise_error(message)).otherwise(F.col("total_frames"))).drop("_n")
    episodes = _table(spark, root, "episodes").drop("from_index", "to_index")
    more = {t: _table(spark, root, t) for t in ("moments", "episodes_stats", "norm_stats", "source_episode_map", "conversion_report") if root.split("/")[-2:-1] == [STAGED]}
    return {"frames": frames, "episodes": episode_offsets(episodes), "tasks": tasks, "info": info, **more}


def write_stats(stats: DataFrame, path: str, *, tag: str, fit_split: str = "train") -> None:
    """Statistics table as JSON lines with its tag and the split it was fitted on."""
    stats.withColumns({"tag": F.lit(tag), "fit_split": F.lit(fit_split)}).write.mode("errorifexists").json(path)


PADS_PER_FIT = 30


def validate_stats(stats: DataFrame, *, tag: str, task_scale: DataFrame | None = None) -> None:
    """Raise unless the pad statistics are train-only, complete, finite and positive."""
    fin = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf)
    bad = lambda c: F.count(F.when(~F.coalesce(c, F.lit(False)), 1))
    r = stats.agg(
        bad(F.col("tag") == tag).alias("tag"), bad(F.col("fit_split") == "train").alias("fit_split"), F.count("*").alias("n"),
        *[bad(fin(c)).alias(c) for c in ("base", "scale", "threshold")], bad(F.col("scale") > 0).alias("positive")).first()
    if r["tag"]:
        raise ValueError(f"expected statistics tagged {tag!r}")
    if r["fit_split"]:
        raise ValueError("expected train-only statistics (fit_split == 'train')")
    if r["n"] != PADS_PER_FIT or r["base"] or r["scale"] or r["threshold"]:
        raise ValueError(f"expected {PADS_PER_FIT} finite baselines, scales and thresholds")
    if r["positive"]:
        raise ValueError("all scales must be positive")
    if task_scale is not None:
        t = task_scale.agg(
            F.count("task").alias("named"), bad(fin("scale") & (F.col("scale") > 0)).alias("bad"), F.count(F.when(F.col("task").isNull(), 1)).alias("default")).first()
        if not t["named"] or t["bad"] or t["default"] != 1:
            raise ValueError("task scales need a non-empty table and a default, all positive and finite")


def read_stats(spark: SparkSession, path: str, *, tag: str, task_scale: DataFrame | None = None) -> DataFrame:
    """Statistics after a strict check."""
    stats = spark.read.json(path)
    validate_stats(stats, tag=tag, task_scale=task_scale)
    return stats
