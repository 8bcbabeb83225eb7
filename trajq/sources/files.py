"""Readers of recording folders: listings, timestamp tables, glove archives, metadata, command logs."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajq.functions.layout import PADS
from trajq.plans.lineage import measured
from trajq.plans.ordered import row_index

PAD_IDS = PADS
PATH = "_path"


def _paths(spark: SparkSession, root: str | Sequence[str], pattern: str) -> DataFrame:
    """Paths below a root or several; file contents are not read, only listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root if isinstance(root, str) else list(root))
    return files.select(F.col("path").alias(PATH))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def scan_recordings(spark: SparkSession, root: str, marker: str = "rgb_head.csv") -> DataFrame:
    """Every folder that holds the marker file: ``path``, ``recording_id`` (folder name)."""
    dirs = _paths(spark, root, marker).select(folder_of(F.col(PATH)).alias("path")).distinct()
    return dirs.select("path", base_of(F.col("path")).alias("recording_id"))


def scan_by_date(spark: SparkSession, root: str, *, dates: Sequence[str] | None = None, listed: DataFrame | None = None, marker: str = "*", sample: int | None = None, seed: int = 0) -> DataFrame:
    """``<root>/<date>/<episode>`` folders of some dates, of a list (``path`` below the root), or n sampled ones."""
    from trajq.operators.sampling import sample_n

    paths = [f"{root}/{d}" for d in dates] if dates else [root]
    dirs = _paths(spark, paths, marker).select(folder_of(F.col(PATH)).alias("path")).distinct()
    dirs = dirs.select("path", base_of(folder_of(F.col("path"))).alias("date"), base_of(F.col("path")).alias("episode"))
    if listed is not None:
        dirs = dirs.join(listed.select(F.col("path").alias("_rel")).distinct(), F.concat_ws("/", "date", "episode") == F.col("_rel"), "left_semi")
    return dirs if sample is None else sample_n(dirs, ["date", "episode"], sample, seed=seed)


def read_ts_csv(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Time stamps of tolerant CSV files: ``recording_id, stream, t_ns, block, line``.

    The time is the last field; a first line with letters and lines that do not parse are
    dropped. ``(block, line)`` orders the samples of a file; files may be split between tasks.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    lines = lines.select(
        F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"),
    ).where(F.col("value") != "")
    lines = lines.withColumn("_letters", F.col("value").rlike("[A-Za-z]"))
    # Only lines with letters can be headers, so only they meet the first line of their file.
    first = lines.where("block = 0").groupBy(PATH).agg(F.min("line").alias("line"))
    wordy = lines.where("_letters").join(first, [PATH, "line"], "left_anti")
    kept = lines.where("NOT _letters").unionByName(wordy.select(*lines.columns))
    seconds = F.element_at(F.split("value", ","), -1).try_cast("double")
    kept = kept.withColumn("_s", seconds).where(F.col("_s").isNotNull())
    return kept.select(
        base_of(folder_of(F.col(PATH))).alias("recording_id"), F.regexp_replace(base_of(F.col(PATH)), r"\.[^.]*$", "").alias("stream"),
        F.rint(F.col("_s") * 1e9).cast("bigint").alias("t_ns"), "block", "line")


#: Names of the time column, in seconds; the first that a file has counts.
TIME_COLUMNS = ("epoch", "epoch_s", "timestamp", "timestamp_s", "time")


def read_frame_table(spark: SparkSession, root: str, pattern: str = "*.csv", *, fps: float = 30.0) -> DataFrame:
    """CSV files, each with a header of its own: ``recording_id, stream, frame_index, t_ns``.

    A field is found by the header of its own file, so files of one call may have other columns or
    another order. Without a time column the time is frame index / ``fps``; without a frame index the
    row number in the file counts. Lines without a readable time or with too few fields are dropped;
    a file whose first line is no header gives no rows.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    lines = lines.select(
        F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"),
    ).where(F.col("value") != "")
    heads = lines.where("block = 0").groupBy(PATH).agg(F.min(F.struct("line", "value")).alias("h"))
    names = F.transform(F.split("h.value", ","), lambda c: F.lower(F.trim(F.translate(c, '"', ""))))
    heads = heads.select(PATH, F.col("h.line").alias("_first"), names.alias("_names")).where(F.exists("_names", lambda c: c.rlike("^[a-z_]")))
    time = F.greatest(F.lit(0), F.coalesce(*[F.nullif(F.array_position("_names", c), F.lit(0)) for c in TIME_COLUMNS], F.lit(0)))
    heads = measured(heads.select(PATH, "_first", F.array_position("_names", "frame_index").alias("_index"), time.alias("_time"), F.size("_names").alias("_width")))
    rows = lines.join(heads, PATH).where(F.col("line") > F.col("_first")).withColumn("_f", F.split("value", ",")).where(F.size("_f") >= F.col("_width"))
    field = lambda at: F.trim(F.translate(F.try_element_at("_f", F.nullif(at, F.lit(0)).cast("int")), '"', ""))
    index = field(F.col("_index")).try_cast("bigint")
    missing = rows.where("_index = 0")
    numbered = missing.withColumn("_row", F.lit(None).cast("bigint"))
    if not heads.where("_index = 0").isEmpty():  # rows of such a file are numbered in its order
        numbered = row_index(missing.withColumn("_key", F.concat_ws("|", PATH)), ["_key"], "line", "_row").drop("_key")
    rows = rows.where("_index > 0").withColumn("_row", index).unionByName(numbered)
    seconds = F.when(F.col("_time") > 0, field(F.col("_time")).try_cast("double")).otherwise(F.col("_row") / F.lit(fps))
    path = F.col(PATH)
    return rows.withColumn("_s", seconds).where("_s IS NOT NULL AND NOT isnan(_s)").select(
        base_of(folder_of(path)).alias("recording_id"), F.regexp_replace(base_of(path), r"\.[^.]*$", "").alias("stream"), F.col("_row").alias("frame_index"),
        F.rint(F.col("_s") * 1e9).cast("bigint").alias("t_ns"))


TACTILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("pad", T.IntegerType()), T.StructField("sample_idx", T.LongType()),
    T.StructField("t_ns", T.LongType()), T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()),
    T.StructField("force", T.ArrayType(T.FloatType())), T.StructField("shear_x", T.ArrayType(T.FloatType())), T.StructField("shear_y", T.ArrayType(T.FloatType())),
])


def decode_npz(archives: DataFrame, *, pads: Sequence[int] = PAD_IDS, rows_per_batch: int = 20_000) -> DataFrame:
    """Glove archives (``path``, ``content``) to one row per pad and sample.

    A damaged archive gives no rows. Rows leave a task in batches, one pad at a time.
    """
    wanted = tuple(pads)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        names = {f"{kind}_{pad}" for pad in wanted for kind in ("tactile", "tf_tactile_x", "tf_tactile_y")}
                        data = {k: z[k] for k in z.files if k in names or k == "timestamps"}
                    t = np.rint(np.asarray(data["timestamps"], np.float64).reshape(-1) * 1e9).astype(np.int64)
                    grids = {pad: data[f"tactile_{pad}"] for pad in wanted if f"tactile_{pad}" in data}
                    if any(g.ndim != 3 or g.dtype.kind not in "fiu" for g in grids.values()):
                        continue
                except Exception:
                    continue
                for pad, grid in grids.items():
                    n, h, w = grid.shape
                    n = min(n, len(t))
                    if n == 0:
                        continue
                    flat = lambda a: list(np.asarray(a[:n], np.float32).reshape(n, -1))
                    sx, sy = (x if x is not None and x.shape[:1] >= (n,) and x.dtype.kind in "fiu" else None for x in (data.get(f"tf_tactile_x_{pad}"), data.get(f"tf_tactile_y_{pad}")))
                    both = sx is not None and sy is not None
                    out = pd.DataFrame({
                        "path": path, "pad": pad, "sample_idx": np.arange(n), "t_ns": t[:n], "h": h, "w": w, "force": flat(grid),
                        "shear_x": flat(sx) if both else [None] * n, "shear_y": flat(sy) if both else [None] * n,
                    })
                    for i in range(0, n, rows_per_batch):
                        yield out.iloc[i:i + rows_per_batch]

    return archives.select("path", "content").mapInPandas(read, TACTILE_SCHEMA)


def read_npz_tactile(spark: SparkSession, root: str, pattern: str = "*_hand_data.npz") -> DataFrame:
    """Glove archives below a root, written once to parquet by the caller."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    d = decode_npz(files)
    return d.withColumns({
        "recording_id": base_of(folder_of(F.col("path"))), "hand": F.regexp_extract(F.col("path"), r"(left|right)_hand_data\.npz$", 1),
    }).drop("path")


def read_json_meta(spark: SparkSession, root: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """One row per JSON file with the wanted fields; an unreadable file gives nulls."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(root)
    j = files.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("j"))
    return j.select("path", base_of(folder_of(F.col("path"))).alias("recording_id"), "j.*")


ARM_SCHEMA = "recording_id string, side string, host_timestamp_ns bigint, accepted boolean, rc int, clutch boolean, target_aa array<double>"
HAND_SCHEMA = "recording_id string, side string, host_timestamp_ns bigint, t_cmd_ns bigint, target array<double>"


def read_arm_cmd(spark: SparkSession, path: str, schema: str = ARM_SCHEMA, pattern: str = "*") -> DataFrame:
    """Accepted arm commands under the clutch (JSON lines)."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema(schema).json(path)
    return df.where("accepted AND rc = 0 AND clutch")


def read_hand_cmd(spark: SparkSession, path: str, schema: str = HAND_SCHEMA, pattern: str = "*") -> DataFrame:
    """Hand commands with a time and a target (JSON lines)."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema(schema).json(path)
    return df.where("t_cmd_ns IS NOT NULL AND target IS NOT NULL")


EXCLUDE_KEYS = ("exclude_reasons", "exclude_episodes", "excluded_episodes", "episodes")


def parse_exclude_list(text: DataFrame, *, value: str = "value", is_json: Column | None = None) -> DataFrame:
    """Ids of exclusion files: JSON (object keys, list, bare list) or lines with # comments."""
    body = F.col(value)
    json_like = F.try_parse_json(body).isNotNull() if is_json is None else is_json
    found = F.coalesce(*[
        F.coalesce(F.json_object_keys(F.get_json_object(body, f"$.{k}")), F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>"))
        for k in EXCLUDE_KEYS])
    listed = F.when(F.ltrim(body).startswith("["), F.from_json(body, "array<string>")).otherwise(found)
    plain = F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(F.regexp_replace(s, "\r", ""))), lambda s: (s != "") & ~s.startswith("#"))
    wrong = F.raise_error(F.lit("unsupported exclude JSON format")).cast("array<string>")
    items = F.when(json_like, F.coalesce(listed, wrong)).otherwise(plain)
    return text.select(F.explode(items).alias("item")).distinct()


def read_exclude_list(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    return parse_exclude_list(text, is_json=F.lit(path.lower().endswith(".json")))
