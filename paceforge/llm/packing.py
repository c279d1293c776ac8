"""Packing by power-of-two decomposition.

A document's ids, with the end id, are cut into pieces whose lengths are the
powers of two in the binary form of its length (after as many pieces of the
full length as fit).  Each piece is a sequence of its own, so no sequence
crosses documents and none is padded; pieces of equal length form a bucket from
which batches of one shape are drawn.

Everything happens where the text is read: no shuffle, and a piece's sequence
id comes from its place in its task.

Edge cases: a null or empty text is one piece holding the end id alone; rows
with equal ids are packed one by one, each with sequences of its own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.bpe import LATIN, OTHER, PieceEncoder
from paceforge.llm.common import slices, table

#: Words with control characters go to the library.
_CONTROL = re.compile(rb"[\x00-\x1f]")
#: The vocabulary's published pre-token pattern for lower-case words, with its classes narrowed to what OTHER lets through.
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[" + LATIN + r"]+|[0-9]|[^0-9" + LATIN + r"]+")


class IdCache(dict):
    """Ids of white-space-separated words as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space before anything else, so a text's ids are
    those of its words in turn.  The first ``keep`` words stay; later ones share
    a part that is emptied when it is full, so memory is bounded.
    """

    def __init__(self, name: str, keep: int, spare: int) -> None:
        super().__init__()
        self.encoder = PieceEncoder(name)
        self.marks = tuple({s[:2].encode() for s in self.encoder.special})
        self.keep, self.spare, self.extra = keep, spare, {}

    def encode(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.encoder.library(text)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.extra.get(word)
        if ids is None:
            text = word.decode()
            if OTHER.search(text) or _CONTROL.search(word):
                ids = self.encode(text)
            else:
                low = text.lower()
                if OTHER.search(low):
                    ids = self.encode(text)
                else:
                    ids = b"".join(map(self.encoder.piece, _PRE_TOKEN.findall(low)))
            if len(word) > 200:
                return ids
            if len(self) < self.keep:
                self[word] = ids
            else:
                if len(self.extra) >= self.spare:
                    self.extra.clear()
                self.extra[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        for mark in self.marks:
            if mark in text:
                return self.encode(text.decode())
        return b"".join(map(self.__getitem__, text.lower().split()))


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to ``n``, largest first, none above ``longest``."""
    out = [longest] * (n // longest)
    rest = n % longest
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append(1 << bit)
    return out


_CACHES: dict = {}


def pack_documents(
    df: DataFrame,
    tokenizer_file: str = "word_bpe_49k.json",
    end_id: int = 2,
    longest: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    worker_cache: int = 150_000,
) -> DataFrame:
    """One row for each piece: where it comes from, where it lies, its checksum and bucket.

    ``longest`` must be a power of two.  With ``with_ids`` the token ids come
    along as binary (little-endian unsigned 32-bit), for a writer of shards.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = end_id.to_bytes(4, "little")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier work of this worker left
        cache = _CACHES.get(tokenizer_file)
        if cache is None:
            cache = _CACHES[tokenizer_file] = IdCache(tokenizer_file, worker_cache, worker_cache // 3)
        for batch in slices(batches):
            row, start, length, crc, total, blobs = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = memoryview(cache.ids(text or b"") + end)
                n, at = len(ids) // 4, 0
                for size in piece_lengths(n, longest):
                    piece = ids[4 * at : 4 * (at + size)]
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        blobs.append(bytes(piece))
                    at += size
            columns = [batch.column(0).take(pa.array(row, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * with_ids, names=names)

    id_type = df.schema[id_col].dataType.simpleString()
    kinds = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = df.select(id_col, text_col).mapInArrow(cut, kinds).withColumnRenamed("id", id_col)
    return (
        pieces.withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
        .withColumn("bucket", F.col("length"))
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
