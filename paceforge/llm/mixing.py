"""Mixing sources to target weights, with DataFrame functions only.

Source shares of all tokens are raised to an exponent and normalised.  The
exponent is bisected: the flattest mix whose entropy is no more than the target
and that repeats no source more than the limit.  Each source's weight times the
budget is then realised by whole blocks: its documents fall into blocks by a
hash; every epoch runs through the blocks in a permutation of its own, and the
last, partial epoch stops where the budget ends, within one block at most.

A block has about as many tokens at every size of a source, so the number of a
source's blocks grows with it.  Blocks are put in order in two levels: bins, by
the first digits of the key they are ordered by, and blocks within a bin; the
tokens before a block are those of the bins before and of the blocks before in
its bin.  No task orders more than a few thousand blocks, or a source's bins.
The bisection needs how many sources there are of each size, which meet in one
row: as many entries as there are different sizes, not sources.

Edge cases: a null text has no tokens; a null source counts as the source "";
documents without tokens go with their block.  If even the natural shares
exceed a limit they are used as they are.  Rows with equal ids get the same
place.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceforge.llm.common import broadcast_if_small, cut_lineage, table

#: A mix's parameters: share of the largest possible entropy, epochs over a source, budget over all tokens.
ENTROPY_SHARE, MAX_REPETITION, BUDGET_SHARE = 0.95, 4.0, 1.0
BLOCK_TOKENS = 20_000
#: Blocks that are ordered in one bin, on average.
BIN_BLOCKS = 4096
_STEPS = 30


def word_tokens(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _id_text(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def source_weights(sizes: DataFrame, entropy_share: float, max_repetition: float, budget_share: float) -> DataFrame:
    """(source, tokens) to (source, tokens, exponent, weight, budget)."""
    of_size = sizes.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    one = of_size.agg(F.array_sort(F.collect_list(F.struct("tokens", "n"))).alias("s"), F.sum(F.col("tokens") * F.col("n")).alias("t"))
    shares = F.transform("s", lambda x: F.struct(F.try_divide(x["tokens"], F.col("t")).alias("p"), x["n"].alias("n")))
    one = one.select("t", F.filter(shares, lambda x: x["p"] > 0).alias("p"))
    one = one.withColumn("m", F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]))

    def fits(alpha: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("a"), F.lit(0.0).alias("r"))
        sums = F.aggregate(
            "p",
            start,
            lambda acc, x: F.struct(
                (acc["z"] + F.pow(x["p"], alpha) * x["n"]).alias("z"),
                (acc["a"] + F.pow(x["p"], alpha) * F.ln(x["p"]) * alpha * x["n"]).alias("a"),
                F.greatest(acc["r"], F.pow(x["p"], alpha) / x["p"]).alias("r"),
            ),
        )
        entropy = F.ln(sums["z"]) - F.try_divide(sums["a"], sums["z"])
        repetition = F.try_divide(sums["r"], sums["z"]) * budget_share
        return (entropy <= entropy_share * F.ln("m")) & (repetition <= max_repetition)

    bounds = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    middle = lambda b: (b["lo"] + b["hi"]) / 2
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(_STEPS)),
        bounds,
        lambda b, _: F.struct(
            F.when(fits(middle(b)), b["lo"]).otherwise(middle(b)).alias("lo"),
            F.when(fits(middle(b)), middle(b)).otherwise(b["hi"]).alias("hi"),
        ),
    )
    solved = one.select("t", "p", F.when(fits(F.lit(0.0)), 0.0).otherwise(found["hi"]).alias("exponent"))
    raised = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + F.pow(x["p"], F.col("exponent")) * x["n"])
    rows = sizes.join(F.broadcast(solved.select("t", "exponent", raised.alias("z"))))  # one row
    share = F.try_divide("tokens", "t")
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.col("exponent")) / F.col("z")).otherwise(F.lit(0.0))
    return rows.select(
        "source", "tokens", "exponent", weight.alias("weight"), F.floor(weight * F.col("t") * budget_share + 1e-6).alias("budget")
    )


def place(df: DataFrame, id_col: str, block_counts: DataFrame) -> DataFrame:
    """Adds the block of each row; ``block_counts``: (source, blocks), one row for each source."""
    number = F.conv(F.substring(_key(_id_text(id_col)), 1, 8), 16, 10).cast("long")
    return df.join(broadcast_if_small(block_counts), "source").withColumn("block", number % F.col("blocks")).drop("blocks")


def ordered_blocks(turns: DataFrame, bin_blocks: int) -> DataFrame:
    """Adds block_rank and before, the tokens of the blocks before, in each epoch's own order of a source's blocks."""
    key = _key(F.col("source"), F.col("block"), F.col("epoch"))
    bins = F.ceil(F.col("blocks") / bin_blocks)
    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")  # rises with the key
    rows = turns.withColumn("key", key).withColumn("bin", F.floor(first * bins / F.lit(float(1 << 32)))).drop("blocks")
    rows = cut_lineage(rows)
    bin_order = Window.partitionBy("source", "epoch").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = rows.groupBy("source", "epoch", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("block_tokens").alias("own"))
    none = F.lit(0).cast("long")
    before = per_bin.select(
        "source",
        "epoch",
        "bin",
        F.coalesce(F.sum("n").over(bin_order), none).alias("ranks_before"),
        F.coalesce(F.sum("own").over(bin_order), none).alias("tokens_before"),
    )
    order = Window.partitionBy("source", "epoch", "bin").orderBy("key", "block")
    inside = rows.withColumn("rank_", F.row_number().over(order)).withColumn(
        "sum_", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")
    )
    return inside.join(broadcast_if_small(before), ["source", "epoch", "bin"]).select(
        *[c for c in turns.columns if c != "blocks"],
        (F.col("ranks_before") + F.col("rank_")).cast("int").alias("block_rank"),
        (F.col("tokens_before") + F.col("sum_")).alias("before"),
    )


def mixing_plan(
    sized: DataFrame,
    id_col: str,
    entropy_share: float = ENTROPY_SHARE,
    max_repetition: float = MAX_REPETITION,
    budget_share: float = BUDGET_SHARE,
    block_tokens: int = BLOCK_TOKENS,
    bin_blocks: int = BIN_BLOCKS,
) -> tuple[DataFrame, DataFrame]:
    """(source, blocks) and (source, block, epoch, block_rank, last_key) from rows (id, source, n_tokens).

    A document of a block belongs to an epoch if ``last_key`` is null or not
    less than the document's own key in that epoch.
    """
    sizes = cut_lineage(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    weights = cut_lineage(source_weights(sizes, entropy_share, max_repetition, budget_share))
    blocks = F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("long")
    block_counts = weights.select("source", blocks.alias("blocks"))
    placed = place(sized, id_col, block_counts)
    own = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0))
    turns = own.join(weights, "source").select(
        "source",
        "block",
        "block_tokens",
        (F.col("budget") - epochs * F.col("tokens")).alias("rest"),
        epochs.alias("full"),
        F.explode(F.sequence(F.lit(0).cast("long"), epochs)).alias("epoch"),
    )
    ranked = ordered_blocks(turns.join(broadcast_if_small(block_counts), "source"), bin_blocks)
    ranked = cut_lineage(
        ranked.filter((F.col("epoch") < F.col("full")) | (F.col("before") < F.col("rest"))).select(
            "source",
            "block",
            "epoch",
            "block_rank",
            F.when(
                (F.col("epoch") == F.col("full")) & (F.col("before") + F.col("block_tokens") > F.col("rest")),
                F.col("rest") - F.col("before"),
            ).alias("room"),
        )
    )
    ends = broadcast_if_small(ranked.filter("room IS NOT NULL").select("source", "block", "epoch", "room"))
    partial = placed.join(ends, ["source", "block"])
    partial = partial.withColumn("key", _key(_id_text(id_col), F.col("epoch")))
    within = Window.partitionBy("source", "epoch").orderBy("key")
    last = (
        partial.withColumn("used", F.sum("n_tokens").over(within))
        .filter("used <= room")
        .groupBy("source", "epoch")
        .agg(F.max("key").alias("last_key"))
    )
    plan = ranked.join(last, ["source", "epoch"], "left").select(
        "source",
        "block",
        "epoch",
        "block_rank",
        F.when(F.col("room").isNotNull(), F.coalesce("last_key", F.lit(""))).alias("last_key"),
    )
    return block_counts, cut_lineage(plan)


def realise(df: DataFrame, id_col: str, block_counts: DataFrame, plan: DataFrame) -> DataFrame:
    """``df`` with columns block, epoch and block_rank, one row for each epoch that holds the document."""
    joined = place(df, id_col, block_counts).join(broadcast_if_small(plan), ["source", "block"])
    key = _key(_id_text(id_col), F.col("epoch"))
    return joined.filter(F.col("last_key").isNull() | (key <= F.col("last_key"))).drop("last_key")


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        word_tokens(F.col(text_col)).alias("n_tokens"),
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits
) -> DataFrame:
    """Rows (id, source, n_tokens, block, epoch, block_rank): the mix, a document once for each of its epochs."""
    sized = cut_lineage(sized_documents(docs, id_col, text_col, source_col))
    block_counts, plan = mixing_plan(sized, id_col, **limits)
    return realise(sized, id_col, block_counts, plan).select(id_col, "source", "n_tokens", "block", "epoch", "block_rank")


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits
) -> DataFrame:
    """The rows of ``docs`` with their own columns, each once for each of its epochs; texts are not shuffled."""
    sized = cut_lineage(sized_documents(docs, id_col, text_col, source_col))
    block_counts, plan = mixing_plan(sized, id_col, **limits)
    names = [f"c{k}" for k in range(len(docs.columns))]  # names of the table can't clash with ours
    own = docs.toDF(*names)
    at = {c: n for c, n in zip(docs.columns, names)}
    keyed = own.select("*", F.coalesce(F.col(at[source_col]).cast("string"), F.lit("")).alias("source"))
    return realise(keyed, at[id_col], block_counts, plan).select(*names).toDF(*docs.columns)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


#: The same mix in SQL.
OP1_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(CAST(doc_id AS VARCHAR), '') AS id_text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
sizes AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sized GROUP BY source),
total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t, count(*) FILTER (tokens > 0) AS n FROM sizes),
p AS (SELECT tokens / t AS p, n FROM sizes, total WHERE tokens > 0),
tries(k, lo, hi, a) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN k = 0 OR ok THEN lo ELSE a END,
         CASE WHEN k = 0 AND ok THEN 0.0 WHEN k = 0 THEN hi WHEN ok THEN a ELSE hi END,
         CASE WHEN k = 0 THEN (lo + hi) / 2 WHEN ok THEN (lo + a) / 2 ELSE (a + hi) / 2 END
  FROM (
    SELECT k, lo, hi, a,
           ln(sum(power(p, a))) - sum(power(p, a) * ln(p) * a) / sum(power(p, a)) <= {ENTROPY_SHARE} * ln(max(n))
           AND max(power(p, a) / p) / sum(power(p, a)) * {BUDGET_SHARE} <= {MAX_REPETITION} AS ok
    FROM tries, p WHERE k <= {_STEPS} GROUP BY k, lo, hi, a)),
solved AS (SELECT CASE WHEN (SELECT hi FROM tries WHERE k = 1) = 0 THEN 0.0 ELSE hi END AS e FROM tries WHERE k = {_STEPS} + 1),
weights AS (
  SELECT source, tokens,
         CAST(floor(CASE WHEN tokens > 0 THEN power(tokens / t, e) / (SELECT sum(power(p, e)) FROM p, solved) ELSE 0 END
                    * t * {BUDGET_SHARE} + 1e-6) AS BIGINT) AS budget,
         greatest(CAST(ceil(tokens / {BLOCK_TOKENS}) AS BIGINT), 1) AS blocks
  FROM sizes, total, solved),
placed AS (
  SELECT s.*, CAST('0x' || substr(md5(id_text), 1, 8) AS BIGINT) % blocks AS block
  FROM sized s JOIN weights USING (source)),
own AS (SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS block_tokens FROM placed GROUP BY source, block),
turns AS (
  SELECT source, block, block_tokens, budget - f * tokens AS rest, f, unnest(range(0, f + 1)) AS epoch
  FROM (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS f FROM own JOIN weights USING (source))),
ranked AS (
  SELECT *, row_number() OVER w AS block_rank, sum(block_tokens) OVER w - block_tokens AS before
  FROM turns
  WINDOW w AS (PARTITION BY source, epoch ORDER BY md5(source || ':' || block || ':' || epoch), block
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
chosen AS (
  SELECT source, block, epoch, block_rank,
         CASE WHEN epoch = f AND before + block_tokens > rest THEN rest - before END AS room
  FROM ranked WHERE epoch < f OR before < rest),
rows_ AS (
  SELECT doc_id, source, n_tokens, block, epoch, block_rank, room,
         sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY md5(id_text || ':' || epoch)) AS used
  FROM placed JOIN chosen USING (source, block))
SELECT doc_id, source, n_tokens, block, epoch, CAST(block_rank AS INTEGER) AS block_rank
FROM rows_ WHERE room IS NULL OR used <= room
"""
