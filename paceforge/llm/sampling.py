"""Bounded, repeatable samples of labelled rows for training."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.llm.common import slices, utf8


def below(h: Column, share: Column) -> Column:
    """Whether a 64-bit hash lies in the lowest ``share`` of all."""
    return F.shiftrightunsigned(h, 1) / F.lit(2.0**63) < share


def first_by_hash(rows: DataFrame, label: str, key: str, per_label: int, max_labels: int = 1000) -> DataFrame:
    """(label, key, h): at most ``per_label`` keys of each of the ``max_labels`` commonest labels, by a hash of ``key``.

    A cut at twice the expected hash, from the estimated number of keys, is made
    where the rows are read, and equal rows count once, so what is ordered
    doesn't grow with the table or with a key that repeats.
    """
    counts = rows.groupBy(label).agg(F.approx_count_distinct(key).alias("label_keys"))
    counts = counts.orderBy(F.desc("label_keys"), label).limit(max_labels)
    near = (
        rows.select(label, key)
        .withColumn("h", F.xxhash64(key))
        .join(F.broadcast(counts), label)
        .filter(below(F.col("h"), (2.0 * per_label + 20) / F.greatest("label_keys", F.lit(1))))
        .select(label, key, "h")
        .distinct()
    )
    first = Window.partitionBy(label).orderBy("h", key)
    return near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= per_label).drop("rank")


def labelled_pieces(
    docs: DataFrame,
    labels: DataFrame | None,
    label: str,
    usable: Column,
    per_label: int,
    pieces: int,
    piece_bytes: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labels: int = 1000,
) -> list[tuple[str, int, bytes]]:
    """(label, id hash, piece) of at most ``per_label`` documents of each label.

    Documents are taken in the order of a hash of their id, so the sample is the
    same on every run and needs no order of the table.  Of each text come at most
    ``pieces`` pieces of ``piece_bytes`` bytes, spread evenly over all of it;
    equal pieces of one id come once.  The driver gets
    max_labels * per_label * pieces * piece_bytes bytes at most, unless ids repeat
    with different texts.
    """
    rows = (labels if labels is not None else docs).filter(usable & F.col(label).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"))
    chosen = first_by_hash(rows, "label", "id", per_label, max_labels)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for lab, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                n = min(pieces, max(1, len(text) // piece_bytes))
                for k in range(n):
                    at = k * (len(text) - piece_bytes) // max(n - 1, 1) if len(text) > piece_bytes and n > 1 else 0
                    for o, v in zip(out, (lab, h, text[at : at + piece_bytes])):
                        o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                names=["label", "h", "piece"],
            )

    found = texts.select("label", "h", "text").mapInArrow(cut, "label string, h long, piece binary").distinct().collect()
    return sorted((r.label, r.h, bytes(r.piece)) for r in found if r.piece)
