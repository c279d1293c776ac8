"""URL verdicts: host and path rules first, gradient-boosted trees for the rest.

A rule names a host suffix and a path prefix; the longest that fits decides.
URLs decided by rules are the labelled ones: the trees learn from lexical
features of a bounded sample of distinct ones and judge every URL that no rule
fits.  Features are length, depth, digit ratio, entropy, parameter counts and
statistics of host suffixes: how many labelled rows have a host's last label, or
its last two, and which share of them is blocked.  They are counted over all
labelled rows and joined to every row.  Rows that train see counts without the
fifth of the URLs (by a hash) that they are in.

Edge cases: a null URL, or one without ``://``, has an empty host and path, no
rule fits it, and the trees judge it by its (possibly zero) features.  Without
labelled URLs of both verdicts the method gives the only one seen, or allow.
Rows with equal ids are judged one by one; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.common import BROADCAST_ROWS, cut_lineage, slices, table
from paceforge.llm.sampling import below

#: (rule, verdict); a rule is a host suffix and, from its first slash on, a path prefix.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

FEATURES = (
    "length", "host_length", "path_length", "query_length", "depth", "labels", "digits", "digit_ratio", "hyphens",
    "entropy", "host_entropy", "parameters", "fragment", "secure", "suffix_block", "suffix_weight",
    "second_block", "second_weight",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        suffix, slash, rest = text.partition("/")
        fits = ((host == suffix) | F.endswith(host, F.lit(f".{suffix}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode(), np.uint8), return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def suffixes(host: Column) -> tuple[Column, Column]:
    """The last label of a host, and its last two."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def lexical(url: str | None, host: str, path: str, suffix_stats: Sequence[float]) -> list[float]:
    """The features of a URL; ``suffix_stats``: the last four."""
    url = url or ""
    _, _, query = url.partition("?")
    query, _, fragment = query.partition("#")
    digits = sum(map(str.isdigit, url))
    out = [
        len(url), len(host), len(path), len(query), sum(1 for s in path.split("/") if s),
        host.count(".") + 1 if host else 0, digits, digits / max(len(url), 1), host.count("-"),
        _entropy(url), _entropy(host), query.count("=") + query.count("&") if query else 0,
        float("#" in url), float(url.startswith("https")),
    ]
    return [float(x) for x in (*out, *suffix_stats)]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: feature, threshold by node; value by leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def blocked(self, x: np.ndarray) -> np.ndarray:
        """Probability that each row is blocked."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Newton boosting of the logistic loss with splits at quantiles."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    features = np.zeros((trees, inner), np.int64)
    thresholds = np.full((trees, inner), np.inf)
    values = np.zeros((trees, leaves))
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf)
            if len(own) > 1:
                gs, hs = g[own].sum(), h[own].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[own, f]
                    gl = np.bincount(b, g[own], len(e) + 1).cumsum()[:-1]
                    hl = np.bincount(b, h[own], len(e) + 1).cumsum()[:-1]
                    gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], f, e[at])
            features[t, k], thresholds[t, k] = best[1], best[2]
            node[own] = 2 * k + 1 + (x[own, best[1]] > best[2])
        leaf = node - inner
        values[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + smooth)
        total += values[t][leaf]
    return features, thresholds, values, start


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Train on features and whether each row is blocked."""
    if not len(y) or y.min() == y.max():
        none = np.zeros((0, 1), np.int64)
        return Trees(none, none.astype(float), np.zeros((0, 2)), 20.0 if len(y) and y[0] else -20.0)
    return Trees(*boost(x, y))


def with_rules(df: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    out = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return out.select("*", rule.alias("rule"), verdict.alias("ruled"))


_FOLDS = 5
#: Tasks among which the rows of a suffix are dealt where its table is too large to broadcast.
_SALTS = 32
_STATS = ("suffix_block", "suffix_weight", "second_block", "second_weight")


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit(9)), F.lit(_FOLDS))


def suffix_counts(ruled: DataFrame) -> DataFrame:
    """(suffix, n, blocked): labelled rows with the suffix in all, then those in each fold, as arrays."""
    rows = ruled.filter("rule IS NOT NULL")
    last, two = suffixes(F.col("host"))
    rows = rows.select(F.explode(F.array_distinct(F.array(last, two))).alias("suffix"), (F.col("ruled") == "block").alias("b"), _fold().alias("fold"))
    in_fold = [F.col("fold") == k for k in range(_FOLDS)]
    return rows.groupBy("suffix").agg(
        F.array(F.count(F.lit(1)), *[F.count_if(f) for f in in_fold]).alias("n"),
        F.array(F.count_if("b"), *[F.count_if(F.col("b") & f) for f in in_fold]).alias("blocked"),
    )


def _looked_up(rows: DataFrame, own: DataFrame, key: str, broadcast_rows: int) -> DataFrame:
    """Rows with the columns that ``own`` has for their suffix ``s_``.

    A table of few suffixes is broadcast.  One of many is joined by a shuffle in which the rows of a suffix are dealt
    among as many tasks as there are salts, each with the suffix's row, so a common one fills no task.
    """
    if own.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(own), F.col("s_") == F.col(key), "left")
    dealt = rows.withColumn("salt_", F.pmod(F.xxhash64("url"), F.lit(_SALTS)).cast("int"))
    spread = own.withColumn("own_salt_", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return dealt.join(spread, (F.col("s_") == F.col(key)) & (F.col("salt_") == F.col("own_salt_")), "left").drop("salt_", "own_salt_")


def with_stats(
    rows: DataFrame, counts: DataFrame, prior: float, out_of_fold: bool = False, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Adds the four statistics of each row's suffixes; ``out_of_fold``: without the row's own fold.

    Last labels, of which the hot ones are, are few and looked up in a table of their own.
    """
    fold = (_fold() + 1).cast("int")
    out = rows
    tables = (counts.filter(~F.contains("suffix", F.lit("."))), counts)
    for suffix, (share, weight), table_ in zip(suffixes(F.col("host")), (_STATS[:2], _STATS[2:]), tables):
        own = table_.select(F.col("suffix").alias(share), F.col("n").alias("n_"), F.col("blocked").alias("b_"))
        out = _looked_up(out.withColumn("s_", suffix), own, share, broadcast_rows).drop(share, "s_")
        sums = [F.get(c, F.lit(0)) - (F.get(c, fold) if out_of_fold else F.lit(0)) for c in ("b_", "n_")]
        b, n = (F.coalesce(c, F.lit(0)).cast("double") for c in sums)
        out = out.withColumns({share: (b + prior) / (n + 1), weight: F.log1p(n)}).drop("n_", "b_")
    return out


def features(batch: pa.RecordBatch) -> np.ndarray:
    columns = [batch.column(c).to_pylist() for c in ("url", "host", "path", *_STATS)]
    return np.array([lexical(u, h, p, stats) for u, h, p, *stats in zip(*columns)]).reshape(batch.num_rows, -1)


def train(ruled: DataFrame, counts: DataFrame, prior: float, sample: int = 20_000, longest: int = 2048) -> Trees:
    """Fit on at most ``sample`` distinct URLs that a rule decides, in the order of a hash; URLs over ``longest`` bytes don't train."""
    x, y = training_rows(ruled, counts, prior, sample, longest)
    return fit(x, y)


def training_rows(ruled: DataFrame, counts: DataFrame, prior: float, sample: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    rows = ruled.filter("rule IS NOT NULL").filter(F.octet_length("url") <= longest)
    n = rows.agg(F.approx_count_distinct("url")).first()[0]
    rows = rows.withColumn("h", F.xxhash64("url")).filter(below(F.col("h"), F.lit((1.5 * sample + 20) / max(n, 1))))
    rows = rows.select("url", "host", "path", "h", (F.col("ruled") == "block").alias("blocked")).distinct()
    rows = with_stats(rows.orderBy("h", "url").limit(sample), counts, prior, out_of_fold=True)
    found = sorted(map(tuple, rows.select("h", "url", "host", "path", *_STATS, "blocked").collect()))
    x = np.array([lexical(u, h, p, stats) for _, u, h, p, *stats, _ in found]).reshape(len(found), len(FEATURES))
    return x, np.array([float(r[-1]) for r in found])


def filter_urls(
    df: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    least: float = 0.6,
) -> DataFrame:
    """Rows (id, host, path, rule, verdict, block_score) for every URL.

    Where no rule fits, a block takes a score of ``least`` or more.
    """
    ruled = with_rules(df, id_col, url_col, rules)
    counts = cut_lineage(suffix_counts(ruled))
    n, blocked = ruled.filter("rule IS NOT NULL").agg(F.count(F.lit(1)), F.count_if(F.col("ruled") == "block")).first()
    prior = (blocked + 0.5) / (n + 1)
    trees = train(ruled, counts, prior)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            p = trees.blocked(features(batch))
            verdict = [r or ("block" if b >= least else "allow") for r, b in zip(batch.column("ruled").to_pylist(), p)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "host", "path", "rule")] + [pa.array(verdict, pa.string()), pa.array(p)],
                names=["id", "host", "path", "rule", "verdict", "block_score"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    out = with_stats(ruled, counts, prior).mapInArrow(
        judge, f"id {id_type}, host string, path string, rule string, verdict string, block_score double"
    )
    return out.withColumnRenamed("id", id_col)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
