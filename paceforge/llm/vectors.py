"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised, projected on Gaussian directions, shifted and quantised;
the cells of ``projections`` directions make a table's key, together with the
label.  Vectors with a common key in any of ``tables`` tables are compared by
exact cosine in double precision.

Both numbers follow from the size of the largest label: as many projections as
keep the expected number of unrelated partners of a vector near ``partners``,
and as many tables as then let a pair at the least cosine meet with a
probability of 1 - ``miss``.  Work thus grows more slowly than with the square
of a label's size, and the recall is the same at every size.

Equal vectors of one label are compared as one and counted as many.

Edge cases: a vector that is null, zero, or holds a null or non-finite
component, and one whose label is null, links with nothing.  Labels may be of any
type and are compared as text.  A null id is never
compared; its component is null and it is kept.  Vectors of other lengths never
link.  Rows with equal ids count as one vector by the component, each of their
vectors is compared, and they count as many in the links of others.  Other
columns are ignored.  An empty table gives an empty result.  Ids that are no
whole numbers raise ValueError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.buckets import Groups, compare_in_buckets, components, joined
from paceforge.llm.common import broadcast_if_small, cut_lineage, row_ids, slices, table
from paceforge.llm.shingles import mix


def same_cell(distance: float, width: float) -> float:
    """Probability that two points at a distance fall into one cell of a random direction."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(rows: int, least: float, width: float, partners: float, miss: float) -> tuple[int, int]:
    """(tables, projections) for a label of so many vectors."""
    near, far = same_cell(math.sqrt(2 - 2 * least), width), same_cell(math.sqrt(2), width)
    for projections in range(4, 64):
        tables = math.ceil(math.log(miss) / math.log1p(-(near**projections)))
        if rows * tables * far**projections <= partners:
            break
    return tables, projections


@lru_cache(maxsize=4)
def directions(size: int, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(977))
    return (
        rng.standard_normal((size, tables * projections)) / width,
        rng.random(tables * projections),
    )


@lru_cache(maxsize=1 << 16)
def label_number(label: bytes) -> int:
    """64 bits of a label, for keys; labels themselves are compared where vectors are."""
    return int.from_bytes(hashlib.blake2b(label, digest_size=8).digest(), "little", signed=True)


def table_keys(unit: np.ndarray, labels: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """(n, tables) keys of unit vectors; the label, the length and the table are part of a key."""
    a, b = directions(unit.shape[1], tables, projections, width)
    cells = np.floor(unit @ a + b).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    keys = mix(labels.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(1 << 40))
    keys = mix(keys + np.uint64(unit.shape[1]))
    for k in range(projections):
        keys = mix(keys + cells[:, :, k])
    return keys.view(np.int64)


def sound_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double precision) for each length of vector; rows that link with nothing are left out."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    values = column.flatten()  # those of null rows are not in it
    flat = np.asarray(values.fill_null(float("nan")), np.float64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = []
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        x = flat[at[rows][:, None] + np.arange(n)]
        sound = np.isfinite(x).all(axis=1) & x.any(axis=1)
        if sound.any():
            out.append((rows[sound], x[sound]))
    return out


def links_within(groups: Groups, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows to be compared whose dot product is ``least`` or more, each in the first bucket they share."""
    a_parts, b_parts = [], []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        for k in range(0, len(a), 1 << 16):
            i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            own = groups.mine(i, j)
            a_parts.append(i[own])
            b_parts.append(j[own])

    sizes = groups.ends - groups.starts
    large = sizes > 48
    for start, end in zip(groups.starts[large].tolist(), groups.ends[large].tolist()):
        for k in range(start, end, 512):
            rows = np.arange(k, min(k + 512, end))
            first = groups.first[rows]
            low = int(first.min())
            if low < end:
                near = x[rows] @ x[low:end].T >= least
                near &= np.arange(low, end) >= first[:, None]
                i, j = np.nonzero(near)
                keep(rows[i], low + j)
    rows = np.flatnonzero(np.repeat(~large, sizes))
    counts = groups.last[rows] - groups.first[rows]
    rows, counts = rows[counts > 0], counts[counts > 0]
    ends = np.cumsum(counts)
    at = 0
    while at < len(rows):  # at most about 2^15 pairs at a time
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 15), side="right")))
        own, n = rows[at:upto], counts[at:upto]
        i = np.repeat(own, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(groups.first[own], n)
        near = np.einsum("pd,pd->p", x[i], x[j]) >= least
        keep(i[near], j[near])
        at = upto
    nothing = np.empty(0, np.int64)
    return (np.concatenate(a_parts), np.concatenate(b_parts)) if a_parts else (nothing, nothing)


def vector_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
    partners: float = 1024.0,
    miss: float = 1e-3,
    width: float = 2.0,
    block_rows: int = 2048,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of ``df``.

    Vectors of one label are linked if their cosine is ``least`` or more;
    n_links counts the other vectors linked directly.
    """

    row_ids(df, id_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    per_label = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    tables, projections = table_plan(per_label.agg(F.max("n")).first()[0] or 1, least, width, partners, miss)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            labels = part.column(2)
            known = np.asarray(labels.is_valid())
            texts = [x or b"" for x in labels.cast(pa.binary()).to_pylist()]
            numbers = np.array([label_number(x) for x in texts], np.int64)
            n = part.num_rows
            d1, d2, keys, unit_bytes = [None] * n, [None] * n, [None] * n, [None] * n
            for own, x in sound_vectors(part.column(1)):
                own, x = own[known[own]], x[known[own]]
                if not len(own):
                    continue
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                raw = x + 0.0  # -0.0 equals 0.0
                tags = numbers[own]
                for i, k, r, u in zip(own.tolist(), table_keys(unit, tags, tables, projections, width), raw, unit):
                    digest = hashlib.blake2b(r.tobytes() + b"|" + texts[i], digest_size=16).digest()
                    d1[i] = int.from_bytes(digest[:8], "little", signed=True)
                    d2[i] = int.from_bytes(digest[8:], "little", signed=True)
                    keys[i], unit_bytes[i] = k, u.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(unit_bytes, pa.binary()),
                    labels,
                ],
                names=["id", "d1", "d2", "keys", "unit", "label"],
            )

    def compare(found: pa.Table) -> pa.RecordBatch | None:
        groups = Groups(found)
        raw = found.column("unit").to_pylist()
        longest = max(map(len, raw))  # shorter ones are filled up with zeros
        x = np.frombuffer(b"".join([u.ljust(longest, b"\0") for u in raw]), np.float64).reshape(len(raw), -1)
        a, b = links_within(groups, x, least)
        labels = found.column("label").combine_chunks().dictionary_encode()
        labels = np.asarray((labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels).indices)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        own = (labels[a] == labels[b]) & (sizes[a] == sizes[b])
        a, b = a[own], b[own]
        copies = found.column("copies").to_numpy()
        n = len(raw)
        links = (np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)).astype(np.int64)
        root = joined(n, a, b)
        moved = np.flatnonzero(root != np.arange(n))
        seen = np.flatnonzero(links)
        ids = groups.ids
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[root[moved]], ids[seen]])),
                pa.array(np.concatenate([ids[moved], ids[seen]])),
                pa.array(np.concatenate([np.zeros(len(moved), np.int64), links[seen]])),
            ],
            names=["a", "b", "links"],
        )

    base = cut_lineage(
        rows.mapInArrow(sketch, "id long, d1 long, d2 long, keys array<long>, unit binary, label string")
    )
    sound = base.filter("id IS NOT NULL AND d1 IS NOT NULL")
    classes = sound.groupBy("d1", "d2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max(F.struct("keys", "unit", "label")).alias("x")
    )
    # a checkpoint keeps the numbers as they are
    classes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("class"), "d1", "d2", "rep", "copies", "x.*"))
    alone = F.col("id").isNull() | F.col("d1").isNull()
    unique = -1 - F.monotonically_increasing_id()
    of_row = base.select("id", F.when(alone, unique).otherwise(F.col("d1")).alias("d1"), F.when(~alone, F.col("d2")).alias("d2"))
    of_row = of_row.join(classes.select("class", "d1", "d2", "rep", "copies"), ["d1", "d2"], "left")
    of_row = cut_lineage(of_row.select("id", F.coalesce("class", "d1").alias("class"), "rep", "copies"))
    items = classes.select(
        F.col("class").alias("id"), F.octet_length("unit").cast("long").alias("bytes"), "keys", "copies", "unit", "label"
    )
    found = cut_lineage(compare_in_buckets(items, compare, "a long, b long, links long", block_rows, 64 << 20))
    per_class = found.filter("links > 0").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    per_id = of_row.filter("class >= 0").groupBy("id").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    several = per_id.filter("least <> most").select("id", "least")
    hung = of_row.join(broadcast_if_small(several), "id").select(F.col("class").alias("a"), F.col("least").alias("b"))
    linked_to = components(found.select("a", "b").filter("a <> b").unionByName(hung))
    named = linked_to.withColumnRenamed("id", "class").join(classes.select("class", "rep"), "class")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = named.join(smallest, "component").select("class", "component_id").join(per_class, "class", "full_outer")
    out = of_row.join(broadcast_if_small(cut_lineage(known)), "class", "left")
    component = F.coalesce("component_id", "rep", "id")
    return out.select(
        F.col("id").alias(id_col),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def op5_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"))
