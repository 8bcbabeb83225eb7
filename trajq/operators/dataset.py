"""Episodes and frames of trajectory datasets: selection, splits, reshaping, joins, summaries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajq.plans.lineage import single
from trajq.plans.quantiles import exact_quantiles

MB = 1024 * 1024
DEFAULT_TASK = "Perform the task."


# Names and prompts

def task_name(name: Column, folder: Column) -> Column:
    """Metadata name, else the folder without its trailing number and separators, else the folder."""
    bare = F.regexp_replace(F.regexp_replace(folder, "[0-9]+$", ""), "[_-]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(bare, F.lit("")), folder)


def task_prompt(steps: Column, name: Column, default: str = DEFAULT_TASK) -> Column:
    """First step, else the name, else a default."""
    return F.coalesce(F.get(steps, 0), F.nullif(name, F.lit("")), F.lit(default))


def task_to_prompt(frames: DataFrame, tasks: DataFrame, *, strict: bool = True) -> DataFrame:
    """Add ``prompt`` by task_index; with ``strict`` an unknown index is an error."""
    j = frames.join(tasks.select("task_index", F.col("task").alias("prompt")), "task_index", "left")
    if not strict:
        return j
    message = F.concat(F.lit("task_index not in task table: "), F.col("task_index").cast("string"))
    return j.withColumn("prompt", F.when(F.col("prompt").isNull(), F.raise_error(message)).otherwise(F.col("prompt")))


# Inventory

def file_inventory(files: DataFrame, required: Sequence[str], *, key: str = "recording_id", file: str = "file") -> DataFrame:
    """Missing required files per recording (``file_diff``), and whether it is complete."""
    need = F.array(*[F.lit(f) for f in required])
    # Only required names are collected, so the set stays as short as the requirement.
    have = F.collect_set(F.when(F.col(file).isin(*required), F.col(file)))
    return files.groupBy(key).agg(have.alias("_have")).select(
        key, F.array_except(need, "_have").alias("missing"), (F.size(F.array_except(need, "_have")) == 0).alias("complete"))


def first_layout(files: DataFrame, layouts: Mapping[str, Sequence[str]], *, key: str = "recording_id", file: str = "file") -> DataFrame:
    """Per recording and logical name the first existing of several relative paths."""
    place = {p: i for ps in layouts.values() for i, p in enumerate(ps)}
    cols = []
    for name, paths in layouts.items():
        rank = F.create_map(*[x for p in paths for x in (F.lit(p), F.lit(place[p]))])
        cols.append(F.min_by(F.when(F.col(file).isin(*paths), F.col(file)), F.when(F.col(file).isin(*paths), F.element_at(rank, F.col(file)))).alias(name))
    return files.groupBy(key).agg(*cols)


def drop_reasons(episodes: DataFrame, files: Sequence[str], videos: Sequence[str], *, tables: Sequence[str] = ("action", "state"), expected: str = "total_frames") -> DataFrame:
    """Add ``reasons`` (empty for a kept episode).

    Columns: ``files``/``videos`` arrays of what exists, ``rows_<table>``, ``total_frames``. Row
    counts are only judged when nothing is missing.
    """
    empty = F.array().cast("array<string>")
    gone = F.concat(
        F.transform(F.array_except(F.array(*[F.lit(f) for f in files]), F.coalesce("files", empty)), lambda f: F.concat(F.lit("missing_"), f)),
        F.transform(F.array_except(F.array(*[F.lit(v) for v in videos]), F.coalesce("videos", empty)), lambda v: F.concat(F.lit("missing_video="), v)),
    )
    parts = []
    want = F.col(expected)
    for t in tables:
        n = F.col(f"rows_{t}")
        parts.append(F.when(n <= 0, F.lit(f"empty_csv_{t}")))
        off = (n > want) | (want - n > 1)
        parts.append(F.when(off, F.concat(F.lit(f"row_mismatch_{t}="), n.cast("string"), F.lit("_expected_"), want.cast("string"))))
    counts = [F.col(f"rows_{t}") for t in tables]
    differ = F.lit(False)
    for c in counts[1:]:
        differ = differ | (c != counts[0])
    text = F.concat(F.lit("csv_row_count_disagreement={"), F.concat_ws(", ", *[F.concat(F.lit(f"'{t}': "), c.cast("string")) for t, c in zip(tables, counts)]), F.lit("}"))
    parts.append(F.when(differ, text))
    return episodes.withColumn("_gone", gone).withColumn(
        "reasons", F.when(F.size("_gone") > 0, F.col("_gone")).otherwise(F.array_compact(F.array(*parts)))).drop("_gone")


# Exclusion and splits

def exclude_episodes(episodes: DataFrame, excluded: DataFrame, *, names: Sequence[str] = ("name", "episode_id"), item: str = "item") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with reason) where any of the naming columns is listed."""
    kept, dropped = episodes, None
    items = excluded.select(F.col(item).alias("_i")).distinct()
    for n in names:
        hit = kept.join(items, kept[n] == items["_i"], "left_semi").withColumn("reasons", F.array(F.lit("excluded_by_file")))
        dropped = hit if dropped is None else dropped.unionByName(hit)
        kept = kept.join(items, kept[n] == items["_i"], "left_anti")
    return kept, dropped


def exclude_anomalous(episodes: DataFrame, anomalies: DataFrame, *, dataset: str = "dataset", index: str = "episode_index") -> DataFrame:
    """Episodes without the anomalous ones.

    Anomaly numbers are 1-based unless the dataset lists a 0; numbers out of range are ignored;
    where nothing would be left, everything is kept.
    """
    base = anomalies.groupBy(dataset).agg(F.max((F.col(index) == 0).cast("int")).alias("_zero"))
    shift = F.when(F.col("_zero") == 1, F.col(index)).otherwise(F.col(index) - 1)
    gone = anomalies.join(base, dataset).select(dataset, shift.alias(index)).distinct().withColumn("_gone", F.lit(True))
    marked = episodes.join(gone, [dataset, index], "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    nothing_left = marked.agg(F.count(F.when(~F.col("_gone"), 1)) == 0).scalar()
    return marked.where(~F.col("_gone") | nothing_left).select(*episodes.columns)


def split_disjoint(splits: DataFrame, *, key: str = "uuid", split: str = "split") -> DataFrame:
    """Ids in more than one split or listed twice (empty when the split file is sound)."""
    return splits.groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n_rows")).where("n_splits > 1 OR n_rows > 1")


def checked_splits(splits: DataFrame, *, key: str = "uuid", split: str = "split") -> DataFrame:
    """The splits, or an error at run time on the first id that is not unique."""
    one = splits.groupBy(key).agg(F.count("*").alias("_n"), F.first(split).alias(split))
    message = F.concat(F.lit("id appears more than once across the splits: "), F.col(key).cast("string"))
    return one.select(key, F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col(split)).alias(split))


def split_select(episodes: DataFrame, splits: DataFrame, which: str, *, key: str = "uuid", split: str = "split") -> DataFrame:
    """Episodes of one split after checking that the splits do not overlap."""
    return episodes.join(checked_splits(splits, key=key, split=split).where(F.col(split) == which), key, "left_semi")


SPLIT_NAMES = {"train": "train", "validation": "val", "test": "holdout"}


def translate_splits(splits: DataFrame, *, split: str = "split") -> DataFrame:
    """Release split names to ours, each id its own block."""
    names = F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])
    return splits.withColumns({split: F.element_at(names, F.col(split)), "block": F.col("uuid")})


def stride_sample(episodes: DataFrame, *, stride: int = 5, horizon: int = 50, index: str = "episode_index", length: str = "length") -> DataFrame:
    """Every ``stride``-th frame with at least ``horizon`` frames left, with its global row."""
    from trajq.operators.windows import episode_offsets

    e = episode_offsets(episodes, index=index, length=length)
    block = F.lit(1_000_000)  # long episodes are expanded block by block
    last = F.col(length) - F.lit(horizon) - 1
    e = e.where(last >= 0).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / block)))).repartition(index, "_b")
    first = F.ceil(F.col("_b") * block / stride) * stride
    end = F.least((F.col("_b") + 1) * block - 1, last)
    frame = F.explode(F.when(first <= end, F.sequence(first, end, F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    return e.select(index, "from_index", frame.alias("frame_index")).select(index, "frame_index", (F.col("from_index") + F.col("frame_index")).alias("row"))


# Columns

def _exists(schema: T.StructType, path: str) -> bool:
    node: T.DataType = schema
    for part in path.split("/"):
        if not isinstance(node, T.StructType) or part not in node.fieldNames():
            return False
        node = node[part].dataType
    return True


def _at(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split("/")))


def repack(df: DataFrame, structure: Mapping, *, optional: Sequence[str] = ()) -> DataFrame:
    """Rename and nest columns by 'a/b' paths; a missing optional source drops its field."""
    def build(node):
        if isinstance(node, Mapping):
            fields = {k: build(v) for k, v in node.items()}
            fields = {k: v for k, v in fields.items() if v is not None}
            return F.struct(*[v.alias(k) for k, v in fields.items()]) if fields else None
        if _exists(df.schema, node):
            return _at(node)
        if node in optional:
            return None
        raise KeyError(node)

    cols = {k: build(v) for k, v in structure.items()}
    return df.select(*[v.alias(k) for k, v in cols.items() if v is not None])


def _leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        path = prefix + f.name
        out += _leaves(f.dataType, path + "/") if isinstance(f.dataType, T.StructType) else [path]
    return out


def rename_by_regex(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    """Rename or drop leaf paths by the first pattern that matches the whole path."""
    out: dict[str, str] = {}
    for path in _leaves(df.schema):
        new: str | None = path
        for pattern, repl in patterns.items():
            if re.fullmatch(pattern, path):
                new = None if repl is None else re.sub(pattern, repl, path, count=1)
                break
        if new is None:
            continue
        if new in out:
            raise ValueError(f"Key '{new}' already exists in output")
        out[new] = path
    names = sorted(out)
    for a, b in zip(names, names[1:]):
        if b.startswith(a + "/"):
            raise ValueError(f"Leaf '{a}' aliases a node of '{b}'")
    tree: dict = {}
    for new, path in out.items():
        node, *rest = new.split("/")
        at = tree
        for part in rest:
            at = at.setdefault(node, {})
            node = part
        at[node] = path
    return repack(df, tree)


def column_alias(df: DataFrame, aliases: Sequence[Sequence[str]], *, last_scale: float | None = None) -> Column:
    """Vector of the first present column of each alias list, the last entry scaled."""
    cells = []
    for names in aliases:
        present = [n for n in names if n in df.columns]
        if not present:
            raise KeyError(f"missing any of columns {tuple(names)}")
        cells.append(F.col(f"`{present[0]}`").cast("double"))
    if last_scale is not None:
        cells[-1] = cells[-1] * F.lit(last_scale)
    return F.array(*cells)


def drop_by_type(df: DataFrame, kind: type | tuple[type, ...] = T.StringType) -> DataFrame:
    """Without the columns of a type (text cannot enter statistics)."""
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, kind)])


def concat_datasets(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Datasets one after the other, each row tagged with its normalization group."""
    out = None
    for i, (group, df) in enumerate(datasets.items()):
        tagged = df.withColumns({"norm_group": F.lit(group), "dataset_order": F.lit(i)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


# Joins of episodes and reports

def match_by_unique_length(runs: DataFrame, episodes: DataFrame, *, key: str = "uuid") -> tuple[DataFrame, DataFrame]:
    """(matches, problems): source runs paired with episodes of the same source by exact length.

    Lengths are counted on both sides first, so an ambiguous length is reported, not multiplied.
    """
    r = runs.groupBy(key, F.col("run_len").alias("length")).agg(F.count("*").alias("n_runs"), F.first("run_start").alias("run_start"))
    e = episodes.groupBy(key, "length").agg(F.count("*").alias("n_episodes"), F.first("episode_index").alias("episode_index"))
    j = e.join(r, [key, "length"], "full").fillna(0, ["n_runs", "n_episodes"])
    good = (F.col("n_runs") == 1) & (F.col("n_episodes") == 1)
    return j.where(good).select(key, "length", "episode_index", "run_start"), j.where(~good).select(key, "length", "n_runs", "n_episodes")


def paired_reports(before: DataFrame, after: DataFrame, keys: Sequence[str], *, target: str = "target", provenance: Sequence[str] = (), atol: float = 1e-7) -> DataFrame:
    """Mismatches between two result tables: rows on one side only, targets apart, provenance apart."""
    a = before.select(*keys, F.col(target).alias("_ta"), F.struct(*provenance).alias("_pa") if provenance else F.lit(0).alias("_pa"), F.lit(1).alias("_a"))
    b = after.select(*keys, F.col(target).alias("_tb"), F.struct(*provenance).alias("_pb") if provenance else F.lit(0).alias("_pb"), F.lit(1).alias("_b"))
    j = a.join(b, list(keys), "full")
    far = F.exists(F.zip_with("_ta", "_tb", lambda x, y: F.coalesce(F.abs(x - y) > atol + 1e-5 * F.abs(y), F.lit(True))), lambda v: v)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(
        n(both).alias("paired"), n(F.col("_b").isNull()).alias("only_before"), n(F.col("_a").isNull()).alias("only_after"),
        n(both & far).alias("target_mismatch"), n(both & ~F.col("_pa").eqNullSafe(F.col("_pb"))).alias("provenance_mismatch"))


def optional_view_join(base: DataFrame, views: Mapping[str, tuple[DataFrame, str]], keys: Sequence[str], placeholder: Column) -> DataFrame:
    """Left-join optional sensors; a missing one becomes the placeholder with mask False."""
    out = base
    for name, (df, value) in views.items():
        out = out.join(df.select(*keys, F.col(value).alias(f"_{name}")), list(keys), "left")
        out = out.withColumns({name: F.coalesce(f"_{name}", placeholder), f"{name}_mask": F.col(f"_{name}").isNotNull()}).drop(f"_{name}")
    return out


# Summaries

def dataset_info(episodes: DataFrame, *, data_bytes: str = "data_bytes", video_bytes: str = "video_bytes", chunk: int = 1000) -> DataFrame:
    """Totals of a dataset: episodes, frames, tasks, sizes in MB rounded up, the train range."""
    mb = lambda c: F.ceil(F.sum(c) / MB).cast("bigint")
    return episodes.agg(
        F.count("*").alias("total_episodes"), F.sum("length").alias("total_frames"), F.count_distinct("task").alias("total_tasks"),
        F.ceil(F.count("*") / chunk).cast("bigint").alias("total_chunks"), mb(data_bytes).alias("data_files_size_in_mb"),
        mb(video_bytes).alias("video_files_size_in_mb"), F.concat(F.lit("0:"), F.count("*").cast("string")).alias("train_range"))


def segment_summary(rows: DataFrame, runs: DataFrame, *, key: str = "recording_id") -> DataFrame:
    """One row: trajectories, runs, legal share, run-length percentiles of first and later runs.

    ``rows``: key, legal, both_engaged, holding; ``runs``: key, run_start, run_len.
    """
    legal = F.col("legal").cast("int")
    a = rows.agg(
        F.count_distinct(key).alias("trajectories"), F.count("*").alias("n_rows"), F.sum(legal).alias("legal"),
        (F.sum(legal) / F.count("*")).alias("legal_share"),
        (F.sum((F.col("both_engaged") & F.col("legal")).cast("int")) / F.sum(legal)).alias("both_engaged_share"),
        (F.sum((F.col("holding") & F.col("legal")).cast("int")) / F.sum(legal)).alias("holding_share"))
    first = runs.groupBy(key).agg(F.min("run_start").alias("_first"), F.count("*").alias("_n"))
    kind = F.when(F.col("run_start") == F.col("_first"), "first").otherwise("later")
    marked = runs.join(first, key).withColumn("kind", kind)
    p = exact_quantiles(marked, ["kind"], F.col("run_len"), {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0})
    names = ["p0", "p10", "p50", "p90", "p100"]
    wide = p.agg(*[F.max(F.when(F.col("kind") == k, F.floor(F.col(c)))).alias(f"{k}_{c}") for k in ("first", "later") for c in names])
    frames = marked.agg(
        F.count("*").alias("n_runs"), (F.sum(F.when(F.col("kind") == "later", F.col("run_len")).otherwise(0)) / F.sum("run_len")).alias("later_share"))
    multi = first.agg(F.count(F.when(F.col("_n") > 1, 1)).alias("multi_run"))
    cols = {}
    for t in (frames, multi, wide):
        row = single(t)
        cols |= {c: row[c] for c in t.columns}
    return a.withColumns(cols)


def incremental_batch(inputs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs whose key (recording, hand, model, rate, ...) has no finished result yet."""
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def parse_metric_log(lines: DataFrame, *, names: Sequence[str] = ("step", "stage1_nce", "stage1_recon", "stage1_total"), line: str = "value") -> DataFrame:
    """(step, ...) of the log lines that carry all the named numbers."""
    found = [F.regexp_extract_all(line, F.lit(rf"{n}=([0-9.eE+-]+)"), 1) for n in names]
    out = lines.select(*[F.try_element_at(f, F.lit(-1)).alias(n) for n, f in zip(names, found)])
    keep = F.lit(True)
    for n in names:
        keep = keep & F.col(n).isNotNull()
    return out.where(keep).select(*[F.col(n).cast("double").alias(n) for n in names])


def roll_partner(df: DataFrame, batch: str, order: str, value: Column, valid: Column) -> DataFrame:
    """Add the next row's value within a bounded batch (the last row takes the first) and pair validity."""
    w = Window.partitionBy(batch).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumns({"_x": value, "_ok": F.coalesce(valid, F.lit(False))})
    d = d.withColumns({
        "partner": F.coalesce(F.lead("_x").over(w), F.first("_x").over(whole)),
        "pair_valid": F.col("_ok") & F.coalesce(F.lead("_ok").over(w), F.first("_ok").over(whole)),
    })
    return d.drop("_x", "_ok")
