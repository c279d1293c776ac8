"""Quality classifier by compression.

Two zstandard dictionaries are built from pieces of texts labelled good and bad.
Every chunk of a text is compressed with each; the difference of the two sizes,
over the text's size, says which class the text resembles.  A logistic curve,
fitted to training texts that the dictionaries have not seen (a class of one
document has no other) and weighted to the classes' shares among all labels,
turns it into a probability.  A small ridge keeps the curve flat while there are
few documents; it is the same at every number.  Evidence counts by
size / (size + 128), so a very short text stays near the share of good labels.

Edge cases: a null or empty text, with nothing to compress, scores the share of
good labels in training.  Without labels of both classes every score is that
share, or 0.5 without any.  Rows with equal ids are scored one by one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.common import id_bucket, slices, table, utf8
from paceforge.llm.sampling import labelled_pieces


#: Size in bytes at which a text's evidence counts by half.
HALF_WEIGHT = 128


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    prior: float
    chunk: int
    level: int


class Scorer:
    """Compresses with both dictionaries; made once in each task."""

    def __init__(self, model: CompressionModel) -> None:
        import zstandard as zstd

        self.model = model
        self.pair = []
        for content in (model.good, model.bad) if model.good and model.bad else ():
            d = zstd.ZstdCompressionDict(content)
            d.precompute_compress(level=model.level)
            self.pair.append(
                zstd.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_dict_id=False).compress
            )

    def difference(self, text: bytes) -> float:
        """(size by bad - size by good) / size, over all chunks of the text."""
        step, good, bad = self.model.chunk, 0, 0
        by_good, by_bad = self.pair
        for at in range(0, len(text), step):
            piece = text[at : at + step]
            good += len(by_good(piece))
            bad += len(by_bad(piece))
        return (bad - good) / len(text)

    def score(self, text: bytes) -> float:
        if not text or not self.pair:
            return self.model.prior
        x = self.model.slope * self.difference(text) + self.model.offset
        x = _logit(self.model.prior) + x * len(text) / (len(text) + HALF_WEIGHT)
        return 1 / (1 + math.exp(-min(max(x, -700.0), 700.0)))


def fit(
    good: list[list[bytes]],
    bad: list[list[bytes]],
    share: float = 0.5,
    dictionary_bytes: int = 262144,
    chunk: int = 1024,
    level: int = 3,
    ridge: float = 0.1,
) -> CompressionModel:
    """Fit on documents given as lists of pieces; ``share``: of good ones among all labels.

    Two thirds of the documents make the dictionaries, the rest fits the curve;
    a class of one document serves for both.
    """
    import zstandard

    empty = CompressionModel(b"", b"", 0.0, 0.0, share, chunk, level)
    if not good or not bad:
        return empty
    content = []
    for own in (good, bad):
        pieces = [p for k, doc in enumerate(own) if k % 3 or len(own) == 1 for p in doc]
        try:
            size = max(512, min(dictionary_bytes, sum(map(len, pieces)) // 4))
            content.append(zstandard.train_dictionary(size, pieces).as_bytes())
        except zstandard.ZstdError:  # too little text for a trained one: use the text itself
            content.append(b"\n".join(pieces)[-dictionary_bytes:])
    scorer = Scorer(CompressionModel(*content, 1.0, 0.0, share, chunk, level))
    rest = [(b"".join(doc), y) for own, y in ((good, 1.0), (bad, 0.0)) for doc in own[::3]]
    x, y = np.array([(scorer.difference(t), y) for t, y in rest]).T
    size = np.array([len(t) for t, _ in rest])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y).mean())
    center, scale = x.mean(), x.std() or 1.0
    z = np.stack([(x - center) / scale, np.ones_like(x)], axis=1) * (size / (size + HALF_WEIGHT))[:, None]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w - _logit(share)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slope = w[0] / scale
    return CompressionModel(*content, float(slope), float(w[1] - slope * center), share, chunk, level)


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2000, pieces: int = 4) -> CompressionModel:
    """Fit on labels of documents whose crc32(id) mod 3 is not 1; at most ``per_label`` documents of each class."""
    usable = id_bucket("doc_id", 3) != 1
    found = labelled_pieces(docs, labels, "quality", usable, per_label, pieces, 1024, max_labels=2)
    counts = dict(labels.filter(usable).filter("quality IN (0, 1)").groupBy("quality").count().collect())
    n = sum(counts.values())
    own: dict[str, dict[int, list[bytes]]] = {"0": {}, "1": {}}
    for label, h, piece in found:  # in the order of the hash, so that the parts of fit() mix all kinds
        if label in own:
            own[label].setdefault(h, []).append(piece)
    good, bad = (list(own[k].values()) for k in ("1", "0"))
    return fit(good, bad, counts.get(1, 0) / n if n else 0.5)


def score_quality(df: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, score, predicted) for every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            s = [scorer.score(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    id_type = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {id_type}, score double")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(id_bucket("id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(df: DataFrame, model: CompressionModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text scores ``least`` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            texts = utf8(batch.column(at))
            yield batch.filter(pa.array([scorer.score(t) >= least for t in texts], pa.bool_()))

    at = df.columns.index(text_col)
    return df.mapInArrow(run, df.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
