"""Comparing the members of hash buckets in bounded blocks.

Near-duplicate operators hash each item into several tables.  Two items with a
common bucket are compared once, in the first bucket they share.  Buckets with
the very same members count as one.  A bucket beyond the block limits is split:
each task gets two blocks of it at most, so no group is ever collected whole,
and no pair becomes a row; a task hands on counts and a spanning forest only.

``compare_in_buckets`` compares all block pairs, for results that count every
link.  ``connect_in_buckets`` needs components only: it compares within blocks,
then one representative for each component and bucket, and then just the block
pairs that still hold different components.  A hot group that hangs together is
thus sent out once, not once for each of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import broadcast_if_small, cut_lineage

#: Small groups are handed over together, up to this many rows or bytes.
_ROWS, _BYTES = 4096, 8 << 20
_TAGS = ("bucket", "lo", "hi")


class Groups:
    """Consecutive groups of one task, sorted by (bucket, lo, hi, block); each is a block or a pair of blocks.

    Row i is to be compared with the rows from ``first[i]`` to ``last[i]``.
    """

    def __init__(self, rows: pa.Table) -> None:
        tags = np.stack([rows.column(c).to_numpy() for c in _TAGS], axis=1)
        n = len(tags)
        cuts = np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1
        self.starts, self.ends = np.concatenate([[0], cuts]), np.append(cuts, n)
        self.ids = rows.column("id").to_numpy()
        self.bucket = tags[:, 0]
        across = tags[:, 1] != tags[:, 2]
        low = rows.column("block").to_numpy() == tags[:, 1]
        sizes = self.ends - self.starts
        split = np.repeat(self.starts + np.add.reduceat(low.astype(np.int64), self.starts), sizes)
        self.last = np.repeat(self.ends, sizes)
        self.first = np.where(across, np.where(low, split, self.last), np.arange(1, n + 1))
        keys = rows.column("keys").combine_chunks()
        values = keys.flatten()
        self._valid = np.asarray(values.is_valid()).reshape(n, -1)
        self._keys = values.fill_null(0).to_numpy(zero_copy_only=False).reshape(n, -1)

    def mine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For which pairs this bucket is the first that both have."""
        same = (self._keys[j] == self._keys[i]) & self._valid[j] & self._valid[i]
        at = same.argmax(axis=1)
        own = np.take_along_axis(np.broadcast_to(self._keys[i], same.shape), at[:, None], axis=1)[:, 0]
        return own == np.broadcast_to(self.bucket[i], own.shape)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The component of each of ``n`` items under links (a, b): its smallest item."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    while (root[root] != root).any():
        root = root[root]
    return root


class Forest:
    """Components among the items of a group, by relabelling; ``root``: those known already."""

    def __init__(self, root: np.ndarray) -> None:
        self.root = root
        self.grown = False

    def union(self, i: int, others: np.ndarray) -> None:
        if len(others):
            roots = np.unique(np.append(self.root[others], self.root[i]))
            if len(roots) > 1:
                self.root[np.isin(self.root, roots[1:])] = roots[0]
                self.grown = True

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a member of the component, other id) for each item that hangs with another; nothing if none was joined."""
        if not self.grown:
            return ids[:0], ids[:0]
        heads = ids[self.root]
        moved = heads != ids
        return heads[moved], ids[moved]


def _blocks(n: Column, size: Column, block_rows: int, block_bytes: int) -> Column:
    return F.greatest(F.ceil(n / block_rows), F.ceil(size / block_bytes), F.lit(1)).cast("int")


def _bucketed(items: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Items that share a bucket: their columns, keys null where not shared, and in_buckets (bucket, blocks)."""
    rows = items.select("id", "bytes", F.explode("keys").alias("bucket"))
    shared = (
        rows.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("bytes").alias("bytes"),
            F.bit_xor(F.xxhash64("id", F.lit(1))).alias("f1"),
            F.bit_xor(F.xxhash64("id", F.lit(2))).alias("f2"),
        )
        .filter("n > 1")
    )
    distinct = shared.groupBy("n", "f1", "f2").agg(F.min("bucket").alias("bucket"), F.max("bytes").alias("bytes"))
    distinct = distinct.select("bucket", _blocks(F.col("n"), F.col("bytes"), block_rows, block_bytes).alias("blocks"))
    return cut_lineage(
        rows.select("id", "bucket")
        .join(distinct, "bucket")
        .groupBy("id")
        .agg(F.collect_list(F.struct("bucket", "blocks")).alias("in_buckets"))
        .join(items, "id")
        .select(
            *[c for c in items.columns if c != "keys"],
            F.transform("keys", lambda k: F.when(F.exists("in_buckets", lambda b: b["bucket"] == k), k)).alias("keys"),
            "in_buckets",
        )
    )


def _spread(members: DataFrame) -> DataFrame:
    """One row for each item and bucket; ``block`` is the item's block there."""
    rows = members.select("*", F.explode("in_buckets").alias("b")).drop("in_buckets")
    rows = rows.select("*", F.col("b.bucket").alias("bucket"), F.col("b.blocks").alias("blocks")).drop("b")
    return rows.withColumn("block", _block_of(F.col("blocks")))


def _block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int")


def _dealt(placed: DataFrame, compare: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``compare`` over whole groups of rows (bucket, lo, hi, block, id, ...)."""
    dealt = placed.repartition(*_TAGS).sortWithinPartitions(*_TAGS, "block", "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, size, count = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tags = np.stack([batch.column(c).to_numpy() for c in _TAGS], axis=1)
            cuts = np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1
            share = batch.nbytes / batch.num_rows
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tags)]):
                now = tuple(tags[a].tolist())
                if now != key and (count >= _ROWS or size >= _BYTES):
                    yield from _compared(held, compare)
                    held, size, count = [], 0, 0
                key = now
                held.append(batch.slice(a, b - a))
                size, count = size + (b - a) * share, count + b - a
        yield from _compared(held, compare)

    return dealt.mapInArrow(run, schema)


def _compared(held: list[pa.RecordBatch], compare: Callable) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks() if held else None
    if rows is not None and rows.num_rows > 1:
        out = compare(rows)
        if out is not None and out.num_rows:
            yield out


def compare_in_buckets(
    items: DataFrame, compare: Callable[[pa.Table], pa.RecordBatch | None], schema: str, block_rows: int, block_bytes: int
) -> DataFrame:
    """``compare`` on each block pair of each bucket with two or more items.

    ``items``: id long, bytes long, keys array<long> and the columns to compare
    by, one row for each id; a key must differ between tables.
    """
    placed = (
        _spread(_bucketed(items, block_rows, block_bytes))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .drop("blocks", "other", "bytes")
    )
    return _dealt(placed, compare, schema)


def connect_in_buckets(
    items: DataFrame,
    attach: Callable[[DataFrame], DataFrame],
    compare: Callable[[pa.Table], pa.RecordBatch | None],
    block_rows: int,
    block_bytes: int,
) -> DataFrame:
    """Edges (a, b) that connect all linked items sharing a bucket.

    ``items`` as in compare_in_buckets(), with small columns only; ``attach``
    adds the large ones to rows of them; ``compare`` may leave out pairs of equal
    ``component`` and returns edges.
    """
    members = _bucketed(items, block_rows, block_bytes)
    own = lambda rows: rows.withColumns({"lo": F.col("block"), "hi": F.col("block")})

    def edges_of(placed: DataFrame) -> DataFrame:
        return cut_lineage(_dealt(placed, compare, "a long, b long"))

    whole = attach(members.withColumn("component", F.col("id")))
    edges = edges_of(own(_spread(whole)).drop("blocks", "bytes"))
    wide = members.withColumn("in_buckets", F.filter("in_buckets", lambda b: b["blocks"] > 1)).filter(F.size("in_buckets") > 0)
    if wide.isEmpty():
        return edges

    def labelled() -> DataFrame:
        known = components(edges)
        rows = wide.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        return cut_lineage(_spread(rows).drop("blocks", "block"))

    # one representative for each component of a bucket
    rows = labelled()
    per = rows.groupBy("bucket", "component").agg(F.min(F.struct(F.xxhash64("id", F.lit(5)), "id", "bytes")).alias("x"))
    per = per.select("bucket", F.col("x.id").alias("id"), F.col("x.bytes").alias("size"))
    many = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter("n > 1")
    many = many.select("bucket", _blocks(F.col("n"), F.col("size"), block_rows, block_bytes).alias("blocks"))
    chosen = rows.join(per.join(many, "bucket").select("bucket", "id", "blocks"), ["bucket", "id"])
    chosen = chosen.withColumn("block", _block_of(F.col("blocks"))).drop("blocks", "bytes")
    edges = cut_lineage(edges.unionByName(edges_of(attach(own(chosen)))))

    # what is left: items outside a bucket's largest component, against all its other items
    rows = labelled()
    per = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    top = per.groupBy("bucket").agg(
        F.max(F.struct("n", "size", "component")).alias("top"), F.count(F.lit(1)).alias("parts"),
        F.sum("n").alias("n"), F.sum("size").alias("size"),
    ).filter("parts > 1")
    largest = _blocks(F.col("top.n"), F.col("top.size"), block_rows, block_bytes)
    outside = _blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"), block_rows, block_bytes)
    top = top.select("bucket", F.col("top.component").alias("main"), largest.alias("c_blocks"), outside.alias("m_blocks"))
    rest = rows.join(top, "bucket")
    if rest.isEmpty():
        return edges
    # blocks of the largest component count down from -1, the others up from 0
    main = F.col("component") == F.col("main")
    rest = rest.withColumn("block", F.when(main, -1 - _block_of(F.col("c_blocks"))).otherwise(_block_of(F.col("m_blocks"))))
    others = F.sequence(F.lit(0), F.col("m_blocks") - 1)
    all_ = F.concat(F.sequence(-F.col("c_blocks"), F.lit(-1)), others)
    rest = rest.withColumn("other", F.explode(F.when(main, others).otherwise(all_)))
    rest = rest.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    left = edges_of(attach(rest.drop("other", "main", "c_blocks", "m_blocks", "bytes")))
    return edges.unionByName(left)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, component), the smallest id of each.

    Alternates two star contractions until nothing changes; each round's edges
    are written to the shared checkpoint folder.  Ids without edges don't occur.
    """
    tie = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut_lineage(tie(edges).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tie(large).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").filter("x <> m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        now = cut_lineage(tie(small).distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
    )
