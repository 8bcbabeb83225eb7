"""Answers of a vision model: text to intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_model_json(raw: Column) -> Column:
    """JSON object text of an answer with fences or prose around it; '{}' without one, null if malformed."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"^`+|`+$", "")
    bare = F.regexp_replace(bare, r"^json", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    text = F.when(F.try_parse_json(bare).isNotNull(), bare).when(inner == "", F.lit("{}")).otherwise(inner)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def _items(json: Column, field: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(json, f"$.{field}"), "array<string>"), F.array().cast("array<string>"))


def _number(x: Column) -> Column:
    return x.try_cast("double")


def free_intervals(json: Column) -> Column:
    """``free`` as an array of (a, b), from pairs or objects; numeric text is salvaged, junk dropped."""
    def pair(e: Column) -> Column:
        is_object = e.startswith("{")
        a = F.when(is_object, F.get_json_object(e, "$.start")).otherwise(F.get_json_object(e, "$[0]"))
        b = F.when(is_object, F.get_json_object(e, "$.end")).otherwise(F.get_json_object(e, "$[1]"))
        return F.struct(_number(a).alias("a"), _number(b).alias("b"))

    return F.filter(F.transform(_items(json, "free"), pair), lambda p: p["a"].isNotNull() & p["b"].isNotNull())


def contact_intervals(json: Column) -> Column:
    """``contacts`` with a usable start and end as structs."""
    def contact(e: Column) -> Column:
        get = lambda f: F.get_json_object(e, f"$.{f}")
        fingers = lambda f: F.from_json(get(f), "array<string>")
        named = fingers("confirmed")
        named = F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(F.coalesce(fingers("fingers"), F.array().cast("array<string>")))
        skip = (F.coalesce(get("uncertain_interval"), F.lit("false")) == "true") | (F.coalesce(get("uncertain"), F.lit("")) == "true")
        return F.struct(
            _number(get("start")).alias("start"), _number(get("end")).alias("end"), named.alias("confirmed"), skip.alias("skip"),
            F.coalesce(get("object"), F.lit("")).alias("object"), get("grip_type").alias("grip_type"))

    objects = F.filter(_items(json, "contacts"), lambda e: e.startswith("{"))
    return F.filter(F.transform(objects, contact), lambda c: c["start"].isNotNull() & c["end"].isNotNull())


def normalize_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``json``, ``contacts``, ``free`` and ``error`` (text when the answer is malformed)."""
    j = responses.withColumn("json", parse_model_json(F.col(raw)))
    return j.withColumns({
        "contacts": contact_intervals(F.col("json")), "free": free_intervals(F.col("json")),
        "error": F.when(F.col("json").isNull(), "malformed response"),
    })


def explode_intervals(parsed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(contacts, free) tables in nanoseconds from normalized responses."""
    ns = lambda c: F.rint(c * 1e9).cast("bigint")
    c = parsed.select(*keys, F.posexplode("contacts").alias("contact_id", "c")).select(
        *keys, "contact_id", ns(F.col("c.start")).alias("start_ns"), ns(F.col("c.end")).alias("end_ns"),
        F.col("c.confirmed").alias("confirmed"), F.col("c.skip").alias("skip"), F.col("c.object").alias("object"))
    f = parsed.select(*keys, F.posexplode("free").alias("free_id", "f")).select(
        *keys, "free_id", ns(F.col("f.a")).alias("start_ns"), ns(F.col("f.b")).alias("end_ns"))
    return c, f
