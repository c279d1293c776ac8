"""Product-quantised codes of vectors, entries found by VA-file filtering.

Components become whole numbers, vectors are cut into equal parts, and each part
position has a codebook of ``entries`` entries, refined in ``rounds`` rounds of
assignment and flooring means.  A part's nearest entry is found as in a VA-file:
each coordinate of the entries is quantised to a cell of ``bits`` bits, a table
made for each query holds the least and the greatest squared distance to every
cell of every coordinate, and the sums over a row of cells bound an entry's
distance from below and above.  Only entries whose lower bound does not exceed
the least upper bound are refined, by exact distances of whole numbers.

A round is one pass over the table: tasks send sums and counts of their entries
(a fixed number of rows each), Spark adds them, and the driver gets the next
codebook, whose size is fixed.  The table itself is never shuffled or held; only
its final codes are, to add up errors by label.

Edge cases: a vector that is null, or holds null or non-finite components, is
dropped, and so is one whose length is not that of the first codebook row, or no
multiple of ``parts``.  Fewer vectors than ``entries`` give smaller codebooks.
Rows with equal ids are coded one by one and count one by one as first entries,
ordered by their components; null ids come last.  Whole numbers are held within
+-2^24 (components of +-16,384), so that distances are exact; sums of errors
beyond a long stay at its largest value.  Other columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.common import BROADCAST_ROWS, cut_lineage, table

SCALE, PARTS, ENTRIES, ROUNDS, BITS = 1024, 4, 256, 4, 4
#: Whole numbers beyond are taken as this.
_MOST = 1 << 24
#: Tasks among which the rows of a label are dealt when errors by label are too many to broadcast.
_SALTS = 32
_LONG = (1 << 63) - 1


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * x), -_MOST, _MOST).astype(np.int64)


def sound_rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``size`` finite components, and those as whole numbers."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False)))
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(flat.fill_null(float("nan")), np.float64).reshape(-1, size)
    sound = np.isfinite(x).all(axis=1)
    return rows[sound], whole_numbers(x[sound])


class VaFile:
    """The entries of one part position, with cells that bound their distances."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries = entries
        n, width = entries.shape
        cells = 1 << bits
        ordered = np.sort(entries, axis=0)
        # cells of about equally many entries; the limits of a cell are its entries' own
        cuts = ordered[np.minimum(np.arange(cells) * n // cells, n - 1)]
        self.cell = np.stack([np.searchsorted(cuts[1:, d], entries[:, d], side="right") for d in range(width)], axis=1)
        self.low = np.full((width, cells), np.inf)
        self.high = np.full((width, cells), -np.inf)
        at = np.arange(width)[None, :].repeat(n, axis=0)
        np.minimum.at(self.low, (at, self.cell), entries)
        np.maximum.at(self.high, (at, self.cell), entries)
        empty = np.isinf(self.low)
        self.low[empty] = self.high[empty] = 0
        # which cell of which coordinate an entry lies in: bounds are sums of a query's table over these
        self.lies = np.zeros((width * cells, n), np.float32)
        self.lies[(at * cells + self.cell).ravel(), np.arange(n)[:, None].repeat(width, axis=1).ravel()] = 1

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of the nearest entry to each row, ties to the lower index; and how many were refined."""
        q = x[:, :, None].astype(np.float64)
        below, above = self.low - q, q - self.high
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(-below, -above)
        n = len(x)
        # sums of as many single-precision terms as a part has coordinates; the margin is more than their rounding
        lower = np.square(least, dtype=np.float32).reshape(n, -1) @ self.lies
        upper = (np.square(most, dtype=np.float32).reshape(n, -1) @ self.lies).min(axis=1)
        likely = ((x - self.entries[lower.argmin(axis=1)]) ** 2).sum(axis=1)  # bounds the least distance as well
        bound = np.minimum(upper, likely) * (1 + 1e-6 * (x.shape[1] + 8))
        row, entry = np.nonzero(lower <= bound[:, None])
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.searchsorted(row, np.arange(n))
        best = np.minimum.reduceat(exact, starts)
        hit = np.flatnonzero(exact == best[row])
        first = hit[np.searchsorted(row[hit], np.arange(n))]
        return entry[first], best, len(row)


def in_parts(batches: Iterable[pa.RecordBatch], column: int, size: int, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            own, x = sound_rows(part.column(column), size)
            if len(own):
                yield part, own, x


def sums_of(books: list[np.ndarray]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: sums and counts of the vectors assigned to each entry."""
    width, n = books[0].shape[1], len(books[0])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(b) for b in books]
        sums, counts = np.zeros((len(books), n, width), np.int64), np.zeros((len(books), n), np.int64)
        for _, _, x in in_parts(batches, 0, width * len(books)):
            for p, file in enumerate(files):
                own = x[:, p * width : (p + 1) * width]
                entry = file.nearest(own)[0]
                np.add.at(sums[p], entry, own)
                counts[p] += np.bincount(entry, minlength=n)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p * n + e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["entry", "n", "sums"]
        )

    return add


def finite(vector: Column, parts: int) -> Column:
    """Whether a vector has finite components only, and as many as can be cut into the parts."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & (F.size(vector) > 0) & (F.size(vector) % parts == 0), F.lit(False))


def first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks of the smallest ids' vectors; those of other lengths than the first are left out."""
    sound = rows.filter(finite(F.col("vector"), parts))
    ordered = [F.asc_nulls_last("id"), "vector"]
    head = sound.orderBy(*ordered).limit(1).collect()  # one row
    if not head:
        return []
    found = sound.filter(F.size("vector") == len(head[0].vector)).orderBy(*ordered).limit(entries).collect()  # a codebook
    whole = whole_numbers(np.array([r.vector for r in found], np.float64))
    return np.split(whole, parts, axis=1)


def refined(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: flooring means of the vectors assigned to each entry; unused entries stay."""
    width, n = books[0].shape[1], len(books[0])
    partial = rows.select("vector").mapInArrow(sums_of(books), "entry long, n long, sums array<long>")
    total = partial.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(width)]).alias("sums"))
    out = [b.copy() for b in books]
    for r in total.collect():  # as many rows as the codebooks have entries
        out[r.entry // n][r.entry % n] = np.array(r.sums, np.int64) // r.n
    return out


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows (id, code, error, label_error, codebooks_sha256), one for each vector that is coded."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook has 1 to 256 entries")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(rows, books)
    width = books[0].shape[1] if books else 0

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not books:
            return
        files = [VaFile(b) for b in books]
        for part, own, x in in_parts(batches, 2, width * parts):
            found = [file.nearest(x[:, p * width : (p + 1) * width]) for p, file in enumerate(files)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())],
                names=["id", "label", "code", "error"],
            )

    coded = cut_lineage(rows.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    # in decimals, so that no sum overflows
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    of_label = coded.groupBy("label").agg(F.least(total, F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    of_label = of_label.withColumnRenamed("label", "of")
    if of_label.limit(broadcast_rows + 1).count() <= broadcast_rows:
        out = coded.join(F.broadcast(of_label), F.col("label").eqNullSafe(F.col("of")))
    else:  # a label's rows are dealt among tasks, each of which has the label's sum
        out = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(_SALTS)).cast("int"))
        spread = of_label.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        out = out.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("own")))
    return out.select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    """Assignment by the codebook of round ``k``, and the codebook after it."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT p, r, v, min((d, e)) AS best
  FROM (SELECT s.p, r, v, e, list_sum(list_transform(list_zip(v, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts s JOIN book{k} b ON s.p = b.p)
  GROUP BY p, r, v),
sums{k} AS (
  SELECT p, best[2] AS e, i, sum(v[i]) AS s, count(*) AS n
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM near{k}) GROUP BY p, best[2], i),
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x
  FROM book{k} b LEFT JOIN (
    SELECT p, e, list((CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END)::BIGINT ORDER BY i) AS x FROM sums{k} GROUP BY p, e) m
  ON b.p = m.p AND b.e = m.e),"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT p, r, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v
  FROM (SELECT *, unnest(range({PARTS})) AS p FROM kept)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS x FROM parts WHERE r <= {ENTRIES}),
{"".join(_round_sql(k) for k in range(ROUNDS))}
last AS (
  SELECT p, r, min((d, e)) AS best
  FROM (SELECT s.p, r, e, list_sum(list_transform(list_zip(v, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts s JOIN book{ROUNDS} b ON s.p = b.p)
  GROUP BY p, r),
coded AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM last GROUP BY r),
books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), books
"""
