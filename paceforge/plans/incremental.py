"""Incremental recomputation: change detection, the dirty queue, versions."""

from __future__ import annotations

import ast
import hashlib
import importlib.util
from collections.abc import Mapping, Sequence
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.functions.hashing import semantic_hash
from paceforge.operators.relational import whole_days

VOLATILE = ("kudos_count", "fetched_at", "athlete_count")


def source_hashes(payloads: DataFrame, volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """(activity_id, source_hash): one hash over an activity's latest payloads, in the order of their kinds."""
    hashed = payloads.select("activity_id", "payload_kind", semantic_hash(F.col("payload_json"), volatile).alias("h"))
    parts = F.array_sort(F.collect_list(F.struct("payload_kind", "h")))
    text = F.array_join(F.transform(parts, lambda p: F.concat_ws("=", p["payload_kind"], p["h"])), ";")
    return hashed.groupBy("activity_id").agg(F.sha2(text, 256).alias("source_hash"))


def changed(hashes: DataFrame, state: DataFrame) -> DataFrame:
    """(activity_id, source_hash, source_revision): new and changed activities, with the next revision.

    ``state``: activity_id, source_hash, source_revision.
    """
    old = state.select("activity_id", F.col("source_hash").alias("old_hash"), F.col("source_revision").alias("old_revision"))
    joined = hashes.join(old, "activity_id", "left")
    return joined.filter(~F.col("source_hash").eqNullSafe(F.col("old_hash"))).select(
        "activity_id", "source_hash", (F.coalesce("old_revision", F.lit(0)) + 1).alias("source_revision")
    )


def merged_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State with the changes in place of their old rows."""
    kept = state.join(changes.select("activity_id"), "activity_id", "left_anti")
    return kept.unionByName(changes.select(*state.columns))


def claim(queue: DataFrame, activities: DataFrame, limit: int) -> DataFrame:
    """Queue rows of the earliest whole days, ``limit`` or a little more."""
    days = activities.select(F.col("id").alias("activity_id"), "activity_day")
    return whole_days(queue.join(days, "activity_id"), limit, "activity_day", "activity_id")


def cleared(queue: DataFrame, claimed: DataFrame) -> DataFrame:
    return queue.join(claimed.select("activity_id"), "activity_id", "left_anti")


def enqueue(queue: DataFrame, ids: DataFrame, reason: str, at: str) -> DataFrame:
    """Queue with ``ids`` (activity_id); an id that waits already starts anew, its attempts at zero."""
    fresh = ids.select("activity_id").distinct().select(
        "activity_id", F.lit(reason).alias("reason"), F.lit(at).alias("enqueued_at"), F.lit(0).cast("long").alias("attempts")
    )
    return cleared(queue, fresh).unionByName(fresh.select(*queue.columns))


#: Modules whose functions compute facts; what they import is found, not listed.
FACT_LOGIC = ("paceforge.plans.facts", "paceforge.plans.materialize")


def _tree(name: str) -> ast.Module | None:
    """A module's syntax tree; None for what has no Python source."""
    spec = importlib.util.find_spec(name)
    source = spec.loader.get_source(name) if spec and hasattr(spec.loader, "get_source") else None
    return ast.parse(source) if source is not None else None


def _imported(name: str, tree: ast.Module) -> set[str]:
    """Names that may be modules, of all imports of a module, those inside functions too."""
    package = name if importlib.util.find_spec(name).submodule_search_locations is not None else name.rpartition(".")[0]
    found: set[str] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if node.level:
                above = package.split(".")[: len(package.split(".")) - node.level + 1]
                base = ".".join([*above, base] if base else above)
            found |= {base, *(f"{base}.{a.name}" for a in node.names)}
    return found


def logic_closure(roots: Sequence[str]) -> dict[str, ast.Module]:
    """The modules of the roots' own packages that the roots import, directly or not, with their syntax trees."""
    tops = {r.partition(".")[0] for r in roots}
    trees: dict[str, ast.Module] = {}
    waiting = sorted(roots)
    while waiting:
        name = waiting.pop()
        if name in trees or name.partition(".")[0] not in tops:
            continue
        try:
            tree = _tree(name)
        except ModuleNotFoundError:  # a function or class of the module before the last dot
            continue
        if tree is not None:
            trees[name] = tree
            waiting += sorted(_imported(name, tree) | {name.rpartition(".")[0] or name})
    return trees


def _without_docstrings(tree: ast.Module) -> ast.Module:
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(node, clean=False) is not None:
            node.body = node.body[1:]
    return tree


def logic_fingerprint(modules: Sequence[ModuleType | str] = FACT_LOGIC) -> str:
    """SHA-256 of the syntax of all code that the modules' results rest on.

    Changing a helper, in whichever module, changes it; comments, docstrings, layout and other modules do not.
    """
    closure = logic_closure([m if isinstance(m, str) else m.__name__ for m in modules])
    digest = hashlib.sha256()
    for name in sorted(closure):
        digest.update(f"{name}\n{ast.dump(_without_docstrings(closure[name]))}\n".encode())
    return digest.hexdigest()


def next_version(stored: tuple[int, str] | None, fingerprint: str) -> tuple[int, bool]:
    """(version, whether everything must be recomputed)."""
    if stored is None:
        return 1, True
    version, known = stored
    return (version, False) if known == fingerprint else (version + 1, True)


def version_status(*facts: DataFrame) -> DataFrame:
    """Rows of each version over all fact tables."""
    out = facts[0].select("metric_version")
    for f in facts[1:]:
        out = out.unionByName(f.select("metric_version"))
    return out.groupBy("metric_version").agg(F.count(F.lit(1)).alias("fact_row_count"))


def pruned(facts: DataFrame, version: int) -> DataFrame:
    """Facts without superseded versions."""
    return facts.filter(F.col("metric_version") >= version)


def pruned_counts(tables: Mapping[str, DataFrame], version: int) -> DataFrame:
    """(table_name, rows): how many superseded rows each fact table holds, zeros included."""
    parts = [df.agg(F.count_if(F.col("metric_version") < version).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
