"""What each filter of a chain removes, in every order of the chain, and what others would have removed anyway.

A document's verdicts are a mask, one bit a filter.  The corpus is counted once,
to cells of (part, mask); everything else follows from those.  In long form, a
row for each mask, order and step, a running bit-or over the earlier steps tells
what was removed before; conditional sums over the cells give the counts of a
step, and a window over a filter's rows in all orders its Shapley total.

The windows over masks are the same for every part, so they run once, over 32
masks (for five filters), and meet the cells by a broadcast of that fixed size.
Cells are spread over parts; a part has as many rows as there are masks, orders
and steps, however many documents it holds.

Repeated texts: equal texts are told by SHA-256, so no text is shuffled.  Rows
that are equal in everything counted are counted before each shuffle, so
thousands of copies of one text are a few rows of it.

Edge cases: a null text is an empty one; a null source is the part ''.  A row
without an id repeats nothing, is repeated by none and has no labels.  Of rows with equal ids
and texts none repeats the other; each counts.  Labels of an id count if any of
its label rows has them.  Other columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceforge.llm.common import slices, table, utf8

#: Letters of the filters; the bit of each is its place.
FILTERS = "ABCDE"
#: A: least words; B: least percentage of distinct words; C: highest percentage of capitals; D: characters not allowed.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
_CAPITALS = bytes(range(0x41, 0x5B))
_REPEAT = 1 << FILTERS.index("E")


def text_mask(text: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a text fails; bytes.split() cuts at \\x20 and \\x09-\\x0D."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * code_points) << 2
        | (len(text) != len(text.translate(None, SYMBOLS))) << 3
    )


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (id, part, digest, mask) of whole texts: the bits of A to D, and the text's SHA-256."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = utf8(part.column(2))
            sizes = pc.fill_null(pc.utf8_length(part.column(2)), 0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([text_mask(t, n) for t, n in zip(texts, sizes)], pa.int32()),
                ],
                names=["id", "part", "digest", "mask"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(judge, f"id {rows.schema['id'].dataType.simpleString()}, part string, digest binary, mask int")


def cells(failures: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, E included."""
    of_id = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = failures.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(of_id, "id", "left").fillna(False, ["good", "toxic"])
    # of one text, part and label: how many rows, and those of the smallest id
    same = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))
    same = same.withColumn("least", least)
    firsts = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    halves = F.array(
        F.struct(F.col("mask"), firsts.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(_REPEAT)).alias("mask"), (F.col("n") - firsts).alias("n")),
    )
    split = same.select("part", "good", "toxic", F.inline(halves)).filter("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def mask_steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(mask, filter_order, step, filter, fails, earlier): each mask against each step of each order.

    ``earlier`` holds the bits of the filters that failed in the steps before.
    """
    if not 1 <= len(filters) <= 7 or len(set(filters)) < len(filters):
        raise ValueError("one to seven filters of different letters")
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])).alias("filter_order")
    masks = spark.range(1 << len(filters)).select(F.col("id").cast("int").alias("mask"), orders)
    steps = masks.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), letter) - 1)
    steps = steps.withColumns({"filter": letter, "fails": F.col("mask").bitwiseAND(bit)})
    before = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))


def interaction_audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step, from cells (part, mask, n, good, toxic)."""
    steps = mask_steps(counted.sparkSession, filters)
    # a part's rows are put in one task, so nothing that is made of them moves again
    rows = counted.repartition("part").join(F.broadcast(steps), "mask")
    fails, earlier = F.col("fails") != 0, F.col("earlier") != 0
    total = lambda test, what="n": F.sum(F.when(test, F.col(what)).otherwise(0))
    out = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(fails & (F.col("mask") == F.col("fails"))).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    # in all orders a part has cells of masks that it holds, and every order and step meets each of them
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = text_failures(table(spark, sf_dir, "documents"))
    return interaction_audit(cells(failures, table(spark, sf_dir, "labels"))).drop("filter")


OP12_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN marks USING (doc_id)),
counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged GROUP BY part, mask),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM f p, f q, f r, f s, f t WHERE p.b | q.b | r.b | s.b | t.b = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INTEGER AS before
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
audited AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
         coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM audited
"""
