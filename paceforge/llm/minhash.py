"""Near-duplicate documents by b-bit MinHash over word shingles.

A document's set holds its distinct five-word shingles.  Minima of 64
permutations give 16 band keys of four minima; documents with an equal key are
candidates.  A signature keeps the low four bits of each minimum in 32 bytes;
the share of equal lanes, corrected for chance collisions, estimates the
similarity of candidates, and those far below the threshold go.  The rest is
confirmed on full sets.

Equal sets form a class first, and classes are compared, by the text of their
smallest id.  At a similarity of exactly 0.85 a pair lacks a common band with
probability 7e-6, and the estimate loses it with 2e-7.

Edge cases: a null or empty text, or one without words, has an empty set and
links with nothing.  A null id is never compared; its component is null and it
is kept.  Rows with equal ids count as one document: each of their texts is
compared, and they share a component.  Other columns are ignored.  An empty
table gives an empty result.  Ids that are no whole numbers raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceforge.llm.buckets import Forest, Groups, components, connect_in_buckets
from paceforge.llm.common import broadcast_if_small, cut_lineage, row_ids, slices, table, utf8
from paceforge.llm.shingles import linked, minima, mix, shingle_sets

_LANES = np.uint64(0x1111111111111111)


def pack_low_bits(values: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, sixteen to a 64-bit word."""
    low = values & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (low.reshape(len(low), -1, 16) << shifts).sum(axis=2, dtype=np.uint64)


def estimate(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of a packed signature to each of others."""
    x = one ^ others
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    lanes = 16 * one.shape[-1]
    same = 1 - np.bitwise_count(x & _LANES).sum(axis=1) / lanes
    return (same - 1 / 16) / (15 / 16)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` minima; equal keys mean an equal band."""
    bands = values.shape[1] // rows
    keys = np.zeros((len(values), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys + values[:, r : bands * rows : rows])
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)


def digests(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit numbers."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    shingle_words: int = 5,
    band_rows: int = 4,
    bands: int = 16,
    margin: float = 0.255,
    block_rows: int = 2048,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of ``df``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    sets.  ``margin`` is how far the estimate may lie below the threshold before
    a candidate goes unconfirmed.
    """
    permutations = band_rows * bands
    if permutations % 16:
        raise ValueError("band_rows * bands must be a multiple of 16")
    row_ids(df, id_col)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = utf8(part.column(1))
            sets = shingle_sets(texts, shingle_words)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys: list = [None] * len(sets)
            packed: list = [None] * len(sets)
            d1: list = [None] * len(sets)
            d2: list = [None] * len(sets)
            if len(full):
                values = minima([sets[i] for i in full], permutations)
                for i, k, p in zip(full.tolist(), band_keys(values, band_rows), pack_low_bits(values)):
                    keys[i], packed[i] = k, p.tobytes()
                    d1[i], d2[i] = digests(sets[i])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array(sizes),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(packed, pa.binary()),
                ],
                names=["id", "n_shingles", "bytes", "d1", "d2", "keys", "packed"],
            )

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        sets = shingle_sets(utf8(rows.column("text").combine_chunks()), shingle_words)
        # an id may have other texts too, and a class comes once
        d1, d2 = rows.column("d1").to_pylist(), rows.column("d2").to_pylist()
        own = np.array([digests(s) == (x, y) for s, x, y in zip(sets, d1, d2)])
        place = np.stack([rows.column(c).to_numpy() for c in ("bucket", "lo", "hi", "id")], axis=1)[own]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1]).any(axis=1)
        keep = np.flatnonzero(own)[fresh]
        if len(keep) < 2:
            return None
        rows, sets = rows.take(pa.array(keep)), [sets[k] for k in keep]
        groups = Groups(rows)
        packed = np.frombuffer(b"".join(rows.column("packed").to_pylist()), np.uint64).reshape(len(sets), -1)
        known = rows.column("component").to_numpy()
        out = [_edges_within(groups, a, b, sets[a:b], packed[a:b], known[a:b]) for a, b in zip(groups.starts.tolist(), groups.ends.tolist()) if b - a > 1]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in out]), pa.int64()) for k in (0, 1)], names=["a", "b"])

    def _edges_within(groups: Groups, start: int, end: int, sets: list, packed: np.ndarray, known: np.ndarray) -> tuple:
        sizes = np.array([len(s) for s in sets], np.int64)
        _, first, inverse = np.unique(known, return_index=True, return_inverse=True)
        forest = Forest(first[inverse])
        confirm = Overlaps(sets) if len(sets) > 8 else None
        for i in range(len(sets)):
            rest = np.arange(groups.first[start + i] - start, groups.last[start + i] - start)
            rest = rest[forest.root[rest] != forest.root[i]]
            small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            rest = rest[100 * small >= percent * large]
            if len(rest):
                rest = rest[estimate(packed[i], packed[rest]) >= percent / 100 - margin]
            if len(rest):
                rest = rest[groups.mine(np.array([start + i]), start + rest)]
            if not len(rest):
                continue
            if confirm is None:
                forest.union(i, rest[[linked(sets[i], sets[j], percent) for j in rest]])
            else:
                both = confirm.of(i, rest)
                forest.union(i, rest[100 * both >= percent * (sizes[i] + sizes[rest] - both)])
        return forest.edges(groups.ids[start:end])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = cut_lineage(
        docs.mapInArrow(
            sketch, "id long, n_shingles long, bytes long, d1 long, d2 long, keys array<long>, packed binary"
        )
    )
    sound = base.filter("id IS NOT NULL AND d1 IS NOT NULL")
    classes = sound.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max(F.struct("bytes", "keys", "packed")).alias("x"))
    # a checkpoint keeps the numbers as they are
    classes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("class"), "d1", "d2", "rep", "x.*"))
    # rows in no class get numbers of their own below 0, so that no join key is null for many rows
    alone = F.col("id").isNull() | F.col("d1").isNull()
    unique = -1 - F.monotonically_increasing_id()
    of_row = base.select(
        "id", "n_shingles", F.when(alone, unique).otherwise(F.col("d1")).alias("d1"), F.when(~alone, F.col("d2")).alias("d2")
    )
    of_row = of_row.join(classes.select("class", "d1", "d2", "rep"), ["d1", "d2"], "left")
    of_row = cut_lineage(of_row.select("id", "n_shingles", F.coalesce("class", "d1").alias("class"), "rep"))
    per_id = of_row.filter("class >= 0").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("class").alias("least"), F.max("class").alias("most")
    )
    again = cut_lineage(per_id.filter("n > 1"))

    texts = docs.filter("id IS NOT NULL")
    if not again.isEmpty():  # rows that repeat are joined into one before anything is dealt by their id
        ids = broadcast_if_small(again.select("id"))
        once = texts.join(ids, "id", "left_semi").groupBy("id", "text").agg(F.count(F.lit(1)).alias("n")).drop("n")
        texts = texts.join(ids, "id", "left_anti").unionByName(once)

    def attach(rows: DataFrame) -> DataFrame:
        wanted = broadcast_if_small(rows.select(F.col("rep").alias("doc")).distinct())
        found = texts.withColumnRenamed("id", "doc").join(wanted, "doc", "left_semi")
        return rows.join(found, F.col("rep") == F.col("doc")).drop("doc")

    items = classes.select(F.col("class").alias("id"), "rep", "d1", "d2", "bytes", "keys", "packed")
    edges = connect_in_buckets(items, attach, compare, block_rows, block_bytes)
    # texts of one id hang together by that id
    several = again.filter("least <> most").select("id", "least")
    hung = of_row.join(broadcast_if_small(several), "id").select(F.col("class").alias("a"), F.col("least").alias("b"))
    linked_to = components(edges.unionByName(hung))
    named = linked_to.withColumnRenamed("id", "class").join(classes.select("class", "rep"), "class")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    joined = named.join(least, "component").select("class", "component_id")
    out = of_row.join(broadcast_if_small(cut_lineage(joined)), "class", "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "rep", "id").alias("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all columns as they are, one for each group of near duplicates.

    The row with a group's smallest id stays; of several rows with that id, one.
    Rows with a null id stay.  Texts are shuffled only if the ids to drop are
    too many to broadcast.
    """
    found = cut_lineage(near_duplicates(df, id_col, text_col, **options).select(F.col(id_col).alias("id"), "kept"))
    dropped = found.filter("NOT kept AND id IS NOT NULL").select("id").distinct()
    again = found.filter("kept AND id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id")
    names = [f"c{k}" for k in range(len(df.columns))]  # names of the table can't clash with ours
    own = names[df.columns.index(id_col)]
    out = df.toDF(*names)
    dropped = dropped.withColumnRenamed("id", "dropped_id")
    out = out.join(broadcast_if_small(dropped), F.col(own) == F.col("dropped_id"), "left_anti")
    if not again.isEmpty():
        again = broadcast_if_small(again.withColumnRenamed("id", "again_id"))
        place = Window.partitionBy(own).orderBy(*[c for c in names if c != own])
        several = out.join(again, F.col(own) == F.col("again_id"), "left_semi")
        several = several.withColumn("nth", F.row_number().over(place)).filter("nth = 1").drop("nth")
        out = out.join(again, F.col(own) == F.col("again_id"), "left_anti").unionByName(several)
    return out.toDF(*df.columns)


class Overlaps:
    """Sizes of intersections among a group's sets, by marking one set at a time."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        vocabulary, self.numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(vocabulary), np.int32)

    def of(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.numbers[self.starts[i] : self.starts[i + 1]]
        self.mark[own] = 1
        starts, ends = self.starts[others], self.starts[others + 1]
        out = np.empty(len(others), np.int64)
        for a in range(0, len(others), 256):
            lengths = (ends - starts)[a : a + 256]
            base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            at = np.arange(lengths.sum()) + np.repeat(starts[a : a + 256] - base, lengths)
            out[a : a + 256] = np.add.reduceat(self.mark[self.numbers[at]], base)
        self.mark[own] = 0
        return out


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
