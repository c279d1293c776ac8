"""Exact token counts with a two-tier lookup.

A byte-level BPE never merges across pre-token borders, so a text's token count
is the sum of its pre-tokens' lengths.  Tier one is a compact table of lengths
of frequent pre-tokens, the same for every task and broadcast once; its size is
bounded by ``table_size``.  Tier two is a cache in each Python worker, filled by
the tokenizer library itself.  No pre-token is ever shuffled by key.

The table only saves time: every count is exact whatever it holds.  It is
therefore gathered from a sample of about ``sample_rows`` texts, dealt to a few
tasks that hand the heads of their counters to the driver.  Where the input is
files, the sample comes from some files that a hash of their names chooses, so
the others aren't opened for it.

Edge cases: a null or empty text has 0 bytes and 0 tokens; rows with equal ids
are counted one by one; other columns of the input are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.bpe import LATIN, OTHER, PieceEncoder
from paceforge.llm.common import slices, table

#: The vocabulary's published pre-token pattern, with its classes narrowed to what OTHER lets through.
_PRE_TOKEN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[" + LATIN + r"]+| ?[0-9]+| ?[^ \t\n\r\f\v0-9" + LATIN + r"]+"
    r"|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
)
#: No pre-token goes from a visible character on to a space.
_UNIT = re.compile(r"(?<=\S)(?= )")


def split_units(text: str, special: tuple[str, ...]) -> list[str]:
    """Cut a text where no pre-token can cross; mostly into single pre-tokens."""
    if OTHER.search(text) or any(s in text for s in special):
        return _UNIT.split(text)
    return _PRE_TOKEN.findall(text)


class LengthCache(dict):
    """Token counts of units; those missing are encoded by the library.

    The first ``keep`` units stay; later ones share a part that is emptied when
    it is full, so memory is bounded.
    """

    def __init__(self, name: str, head: dict[str, int], keep: int, spare: int) -> None:
        super().__init__(head)
        self.encoder = PieceEncoder(name)
        self.special = self.encoder.special
        self.keep, self.spare, self.extra = len(head) + keep, spare, {}

    def __missing__(self, unit: str) -> int:
        n = self.extra.get(unit)
        if n is None:
            if _PRE_TOKEN.fullmatch(unit) and not OTHER.search(unit):
                n = self.encoder.count(unit)
            else:
                n = len(self.encoder.library(unit))
            if len(unit) > 200:
                return n
            if len(self) < self.keep:
                self[unit] = n
            else:
                if len(self.extra) >= self.spare:
                    self.extra.clear()
                self.extra[unit] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, split_units(text, self.special)))


def sampled(df: DataFrame, text_col: str, sample_rows: int, files: int = 16) -> DataFrame:
    """About ``sample_rows`` texts, or all if there are fewer; from ``files`` files, or as many more as hold so many.

    Files are taken in the order of a hash of their names.  Rows that don't come straight from files are
    sampled from all.
    """
    names = sorted({n.rsplit("/", 1)[-1] for n in df.inputFiles()}, key=lambda n: md5(n.encode()).digest())
    rows = df
    while files < len(names):
        try:
            some = df.filter(F.col("_metadata.file_name").isin(names[:files]))
            if some.count() >= sample_rows:
                rows = some
                break
        except AnalysisException:  # no file columns: the rows were joined or grouped
            break
        files *= 4
    share = sample_rows / max(rows.count(), 1)
    return (rows.sample(share, seed=17) if share < 1 else rows).select(text_col)


def frequent_units(
    df: DataFrame, text_col: str, special: tuple[str, ...], table_size: int, counter_size: int, sample_rows: int, tasks: int = 8
) -> list[str]:
    """Frequent pre-tokens of about ``sample_rows`` texts; the driver gets ``tasks`` * ``table_size`` of them at most.

    A counter beyond ``counter_size`` entries is cut to its larger half.
    """

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split_units(text, special))
                    if len(seen) > counter_size:
                        seen = Counter(dict(seen.most_common(counter_size // 2)))
        top = [(u, n) for u, n in seen.most_common(table_size) if n > 1 and len(u) <= 200]
        yield pa.RecordBatch.from_pydict(
            {"unit": pa.array([u for u, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    merged: Counter = Counter()
    for r in sampled(df, text_col, sample_rows).repartition(tasks).mapInArrow(heads, "unit string, n long").collect():
        merged[r.unit] += r.n
    return [u for u, _ in merged.most_common(table_size)]


def count_tokens(
    df: DataFrame,
    tokenizer_file: str = "byte_bpe_50k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    table_size: int = 20_000,
    counter_size: int = 100_000,
    worker_cache: int = 200_000,
    sample_rows: int = 20_000,
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for every text of ``df``.

    ``tokenizer_file`` is a name that ``public_tokenizers.path`` knows, or a path
    that exists on every machine.
    """
    spark = df.sparkSession
    probe = LengthCache(tokenizer_file, {}, 0, 1000)
    units = frequent_units(df, text_col, probe.special, table_size, counter_size, sample_rows)
    head = spark.sparkContext.broadcast({u: probe[u] for u in units})
    run = uuid.uuid4().hex

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if run not in _CACHES:
            _CACHES.clear()
            _CACHES[run] = LengthCache(tokenizer_file, head.value, worker_cache, worker_cache // 2)
        cache = _CACHES[run]
        for batch in slices(batches):
            texts = batch.column(1)
            n_tokens = [cache.count(t) if t else 0 for t in texts.to_pylist()]
            n_bytes = [len(b) if b else 0 for b in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, text_col).mapInArrow(
        count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean"
    )
    return out.withColumnRenamed("id", id_col)


#: One cache for each worker process; workers live on from task to task.
_CACHES: dict = {}


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
