"""Changes in the shape of source payloads: detected, not enforced."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unknown_keys(payload: Column, known: Sequence[str]) -> Column:
    """Top-level keys of a JSON object that ``known`` lacks, sorted; empty for anything else."""
    keys = F.json_object_keys(payload)
    found = F.array_except(keys, F.array(*[F.lit(k) for k in known]))
    return F.array_sort(F.coalesce(found, F.array().cast("array<string>")))


def drift_report(payloads: DataFrame, known: Sequence[str], silent: Sequence[str] = ()) -> DataFrame:
    """(kind, key, rows): keys that are new, and ``silent`` keys, known to be always null, that now hold values."""
    new = payloads.select(F.lit("unknown").alias("kind"), F.explode(unknown_keys(F.col("payload_json"), known)).alias("key"))
    for k in silent:
        live = payloads.filter(F.get_json_object("payload_json", f"$.{k}").isNotNull())
        new = new.unionByName(live.select(F.lit("activated").alias("kind"), F.lit(k).alias("key")))
    return new.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("rows"))


_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _kind(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[kind], F.lit("number"))


def json_paths(payloads: DataFrame, depth: int = 3, items: int = 3, column: str = "payload_json") -> DataFrame:
    """(path, parent, kind, value): every value of the payloads down to ``depth`` levels, of arrays the first ``items`` items.

    Paths are like ``gear.name`` and ``laps[].id``; ``value`` is a variant.  Texts that are no JSON have no paths.
    Each level explodes the one before and carries its values along, each on the row of its first child, so that
    all levels come from one scan, a payload is parsed once and nothing is shuffled.
    """
    spark = payloads.sparkSession
    rows = payloads.select(F.try_parse_json(column).alias("value0"), F.lit("").alias("path0"))
    for k in range(1, depth + 1):
        child = spark.tvf.variant_explode_outer(F.col(f"value{k - 1}").outer()).toDF("pos", "key", "value")
        above = [c for j in range(1, k) for c in (f"told{j}", f"path{j}", f"value{j}")]
        first = F.coalesce(F.col("pos") == 0, F.lit(True))
        told = F.col("key").isNotNull() | F.coalesce(F.col("pos") < items, F.lit(False))
        before = F.col(f"path{k - 1}")
        name = F.when(F.col("key").isNull(), F.concat(before, F.lit("[]"))).otherwise(F.concat_ws(".", F.nullif(before, F.lit("")), "key"))
        rows = rows.lateralJoin(child).filter(told | first).select(
            "path0",
            *[(F.col(c) & first).alias(c) if c.startswith("told") else F.col(c) for c in above],
            told.alias(f"told{k}"),
            F.when(told, name).alias(f"path{k}"),
            F.when(told, F.col("value")).alias(f"value{k}"),
        )
    levels = [
        F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("told", "path", "value")], F.col(f"path{k - 1}").alias("parent"))
        for k in range(1, depth + 1)
    ]
    return rows.select(F.inline(F.array(*levels))).filter("told").select("path", "parent", _kind(F.col("value")).alias("kind"), "value")


def nested_drift(
    payloads: DataFrame, known: Sequence[str], paid: Mapping[str, str] | None = None, depth: int = 3, items: int = 3
) -> DataFrame:
    """(change, path, kind, rows): paths that are new, and paid-only ones that now hold values.

    ``known``: paths as json_paths() has them; items of a known array are known.  Of what is new inside something new
    only the outermost is told.  ``paid``: paths with the JSON that stands for nothing there; null always does,
    and so do an empty array and object where the JSON is one.
    """
    rows = json_paths(payloads, depth, items)
    names = [*known, *(f"{k}[]" for k in known), ""]
    kind, value = F.col("kind"), F.col("value")
    changes = [F.when(~F.col("path").isin(names) & F.col("parent").isin(names), F.lit("unknown"))]
    for path, nothing in (paid or {}).items():
        empty = F.try_parse_json(F.lit(nothing))
        number = F.try_variant_get("value", "$", "double").eqNullSafe(F.try_variant_get(empty, "$", "double"))
        same = F.when(kind == "number", number).otherwise(F.to_json(value) == F.to_json(empty))
        changes.append(F.when((F.col("path") == path) & (kind != "null") & ~same, F.lit("activated")))
    known_values = F.col("path").isin([k for k in names if k not in (paid or {})])
    found = rows.filter(~known_values).select(F.explode(F.array_compact(F.array(*changes))).alias("change"), "path", "kind")
    return found.groupBy("change", "path", "kind").agg(F.count(F.lit(1)).alias("rows"))
