"""Quality rules by bands of zstandard ratios.

A text's compressed size over its size tells repetition (low) from noise
(high).  Short texts compress badly whatever they hold, so both limits depend on
the length.  The ratio of the whole text finds repetition anywhere in it; ratios
of fixed chunks find a text of which a part only is repetitive or noise.  What
the last full chunk leaves is covered by a chunk that ends with the text.

Edge cases: a null or empty text has no words and fails the base rule.  Rows
with equal ids are judged one by one; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.common import slices, table, utf8
from paceforge.llm.shingles import _PLACES, mix, word_hashes, words

#: (least bytes, lowest ratio, highest ratio) for whole texts; the last row that fits holds.
BANDS = ((0, 0.0, 99.0), (128, 0.40, 1.10), (256, 0.33, 0.95), (1024, 0.28, 0.80), (4096, 0.25, 0.75))
#: Chunk size in bytes, limits of a chunk's ratio, and the share of chunks that may lie outside.
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 1024, 0.25, 0.75, 0.25

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SOLID_CHAR = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)


def repeated_words(windows: np.ndarray, n_words: int, width: int) -> int:
    """Words that lie in a window found twice or more; ``windows``: a hash for each start."""
    ordered = np.sort(windows)
    twice = ordered[1:] == ordered[:-1]
    if not twice.any():
        return 0
    starts = np.flatnonzero(np.isin(windows, ordered[1:][twice]))
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def base_counts(texts: list[bytes], width: int = 8) -> dict[str, np.ndarray]:
    """Counts of the base rule for each text."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = words(data)
    hashes = word_hashes(data, starts, ends, lower=False)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    borders = np.append(np.searchsorted(starts, text_at), len(starts))
    n = len(hashes)
    full = np.zeros(max(n - width + 1, 0), _U)
    for k in range(width if len(full) else 0):
        full += hashes[k : n - width + 1 + k] * _PLACES[k]
    full = mix(full)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[text_at + sizes] - sums[text_at]

    repeats = np.zeros(len(texts), np.int64)
    dup_lines = np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
        if b - a > width:
            repeats[i] = repeated_words(full[a : b - width + 1], b - a, width)
        if b - a > 1:
            lines = [line for line in texts[i].split(b"\n") if line and not line.isspace()]
            dup_lines[i] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(borders),
        "word_chars": per_text(_SOLID_CHAR[data]),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
    }


def ratios(text: bytes, compressor) -> tuple[float, float]:
    """Ratio of the whole text and share of its chunks outside the chunk limits; a text below a chunk has none."""
    if not text:
        return 0.0, 0.0
    whole = len(compressor.compress(text)) / len(text)
    starts = list(range(0, len(text) - CHUNK + 1, CHUNK))
    if starts and len(text) % CHUNK:
        starts.append(len(text) - CHUNK)
    odd = 0
    for a in starts:
        r = len(compressor.compress(text[a : a + CHUNK])) / CHUNK
        odd += not CHUNK_LOW <= r <= CHUNK_HIGH
    return whole, odd / len(starts) if starts else 0.0


def within_bands(size: int, whole: float, odd_share: float) -> bool:
    low, high = next((a, b) for least, a, b in reversed(BANDS) if size >= least)
    return low <= whole <= high and odd_share <= CHUNK_SHARE


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """Rows (id, base counts, base_failed, ratio, odd_chunks, kept) for every text."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=level, write_content_size=False)
        for part in slices(batches):
            texts = utf8(part.column(1))
            counts = base_counts(texts)
            both = [ratios(t, compressor) for t in texts]
            n = counts["n_words"]
            failed = (n < 20) | (100 * counts["n_repeat_words"] > 30 * n)
            fits = [within_bands(len(t), *r) for t, r in zip(texts, both)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0)]
                + [pa.array(counts[c], pa.int64()) for c in _COUNTS]
                + [
                    pa.array(failed),
                    pa.array([r[0] for r in both], pa.float64()),
                    pa.array([r[1] for r in both], pa.float64()),
                    pa.array(~failed & np.array(fits, bool)),
                ],
                names=["id", *_COUNTS, "base_failed", "ratio", "odd_chunks", "kept"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    kinds = ", ".join(f"{c} long" for c in _COUNTS)
    out = df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        judge, f"id {id_type}, {kinds}, base_failed boolean, ratio double, odd_chunks double, kept boolean"
    )
    return out.withColumnRenamed("id", id_col)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
