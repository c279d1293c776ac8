"""Hashes of JSON payloads that ignore key order and volatile keys."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: str | None, volatile: Iterable[str] = ()) -> str | None:
    """Sorted keys, volatile keys gone at every level, nested JSON texts parsed; other text as it is."""
    drop = frozenset(volatile)

    def clean(x: object) -> object:
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in drop}
        if isinstance(x, list):
            return [clean(v) for v in x]
        if isinstance(x, str) and x[:1] in ("{", "["):
            try:
                return clean(json.loads(x))
            except ValueError:
                return x
        return x

    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def semantic_hash(payload: Column, volatile: Iterable[str] = ()) -> Column:
    """SHA-256 of the canonical form; an Arrow UDF, as no built-in orders JSON keys."""
    drop = tuple(volatile)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashlib.sha256(canonical(t, drop).encode()).hexdigest())

    return run(payload)


def semantically_changed(old: Column, new: Column, volatile: Iterable[str] = ()) -> Column:
    """Whether two payloads differ in more than the order of keys, layout and volatile keys.

    Equal texts are told by comparing them: only those that differ are parsed and hashed.
    """
    drop = tuple(volatile)
    differ = ~old.eqNullSafe(new)
    hashes = [semantic_hash(F.when(differ, x), drop) for x in (old, new)]
    return differ & ~hashes[0].eqNullSafe(hashes[1])


def raw_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)
