"""Language-model scores by a subword lattice.

The vocabulary is that of a public sentencepiece model; its pieces are never
changed.  The file's own scores are merge ranks, not probabilities, so each
piece's score is its share among the pieces of all training words: cut as the
model cuts them at first, then over all their segmentations by a few rounds of
expectation maximisation, each over every row of the words table.  A word's
probability is the sum over all ways to cut it into pieces (single bytes
included), by forward recursion in log space; a text's is the product over its
words and one end.

Word counts of the whole corpus are gathered by a shuffle on the word, and each
distinct word is scored once.  Words above a count, ``table_size`` of them at
most, are broadcast with both scores; the rest of each document's words meet
their scores in a join on the word, so neither the driver nor a task ever holds
the whole vocabulary.  A word of more than 64 bytes is looked up by its digest, so
one that every document holds is broadcast like any other.  A text's sums are of
decimals, and do not depend on the order of its words; fitting adds doubles in the
order in which a shuffle gives words, so piece scores may differ between runs in
their last digits.

Edge cases: a null or empty text is the end alone.  A row with a null id is
scored and not learned from.  Rows with equal ids are scored, and learned from,
one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.bpe import resolve
from paceforge.llm.common import cut_lineage, id_bucket, slices, table, utf8
from paceforge.llm.shingles import mix

_MARK = "▁"
#: The key of the end among piece counts; no piece is empty.
_END = ""
#: A product of probabilities below this has too few digits left.
_LEAST = 1e-200


class Lattice:
    """log10 probability of words over all their segmentations."""

    def __init__(self, log_p: dict[str, float], byte_log_p: list[float]) -> None:
        self.log_p, self.byte_log_p = log_p, byte_log_p
        self.longest = max(map(len, log_p), default=1)

    def _edges(self, text: str, j: int) -> list[tuple[int, str | None, float]]:
        """(start, piece, log probability) of what may end at ``j``; an edge without a piece is a character's bytes."""
        get = self.log_p.get
        own = [(j - 1, None, sum([self.byte_log_p[b] for b in text[j - 1].encode()]))]
        for i in range(max(0, j - self.longest), j):
            p = get(text[i:j])
            if p is not None:
                own.append((i, text[i:j], p))
        return own

    def word(self, word: bytes) -> float:
        """log10 probability of a word; holds the sums of the last few places only."""
        text = _MARK + word.decode()
        ring = [0.0] * (self.longest + 1)
        size = len(ring)
        for j in range(1, len(text) + 1):
            ring[j % size] = _log_sum([ring[i % size] + p for i, _, p in self._edges(text, j)])
        return ring[len(text) % size] / math.log(10)

    def expect(self, word: bytes, times: float, into: dict[str, float], by_byte: np.ndarray | None = None) -> None:
        """Add the expected number of each piece in ``times`` occurrences of a word; that of single bytes to ``by_byte``."""
        text = _MARK + word.decode()
        alpha = array("d", [0.0])
        for j in range(1, len(text) + 1):
            alpha.append(_log_sum([alpha[i] + p for i, _, p in self._edges(text, j)]))
        ahead: dict[int, list[float]] = {len(text): [0.0]}  # of the places still to come, as far as a piece reaches
        for j in range(len(text), 0, -1):
            if j not in ahead:
                continue
            rest = _log_sum(ahead.pop(j))
            for i, piece, p in self._edges(text, j):
                ahead.setdefault(i, []).append(rest + p)
                share = times * math.exp(alpha[i] + p + rest - alpha[-1])
                if piece is not None:
                    into[piece] = into.get(piece, 0.0) + share
                elif by_byte is not None:
                    for b in text[i].encode():
                        by_byte[b] += share


class Expectations:
    """What Lattice.expect() and Lattice.word() find, for many words at once.

    Sums are of plain products; a word that is too long, or too unlikely for a
    double, goes to the lattice.
    """

    def __init__(self, lattice: Lattice, most_chars: int = 64, most_cells: int = 1 << 20) -> None:
        self.lattice, self.most_chars, self.most_cells = lattice, most_chars, most_cells
        self.pieces = list(lattice.log_p)
        hashes = np.zeros(len(self.pieces), np.uint64)
        sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            codes = np.frombuffer("".join([self.pieces[k] for k in own]).encode("utf-32-le"), np.uint32)
            for c in codes.reshape(-1, n).T:
                hashes[own] = _extended(hashes[own], c.astype(np.uint64))
        # tables by 20 bits of the hash, each for the pieces that find no place of their own in those before
        self.hashes, self.slots = hashes, []
        left, shift = np.arange(len(hashes)), 44
        while len(left):
            slot = np.zeros(1 << 20, np.int64)
            top = self._slot(hashes[left], shift)
            slot[top] = left
            self.slots.append((shift, slot))
            left, shift = left[slot[top] != left], max(shift - 11, 0)
        # the last is for what is no piece
        self.p = np.exp(np.array([lattice.log_p[p] for p in self.pieces] + [-np.inf]))
        self.counts = np.zeros(len(self.pieces))
        self.by_byte = np.zeros(256)
        self.char_p: dict[int, float] = {}

    @staticmethod
    def _slot(hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes >> np.uint64(shift)) & np.uint64(0xFFFFF)).astype(np.int64)

    def add(self, words: list[bytes], times: list[int]) -> None:
        """Add the expected numbers in ``times`` occurrences of each word to ``counts`` and ``by_byte``."""
        self._walk(words, np.array(times, float))

    def scores(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word."""
        return self._walk(words, None)

    def _walk(self, words: list[bytes], times: np.ndarray | None) -> np.ndarray:
        texts = [_MARK + w.decode() for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.full(len(texts), np.nan)
        for n in np.unique(sizes[sizes <= self.most_chars]).tolist():
            own = np.flatnonzero(sizes == n)
            step = max(1, self.most_cells // (n * min(n, self.lattice.longest)))
            for a in range(0, len(own), step):
                at = own[a : a + step]
                out[at] = self._many(n, [texts[k] for k in at], None if times is None else times[at])
        extra: dict[str, float] = {}
        for k in np.flatnonzero(np.isnan(out)).tolist():
            if times is None:
                out[k] = self.lattice.word(words[k])
            else:
                self.lattice.expect(words[k], times[k], extra, self.by_byte)
        if extra:
            self.counts += [extra.get(p, 0.0) for p in self.pieces]
        return out

    def _many(self, n: int, texts: list[str], times: np.ndarray | None) -> np.ndarray:
        """log10 probability of words of ``n`` characters, NaN if too small; arrays are by place first, then by word."""
        codes = np.ascontiguousarray(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(-1, n).T)
        single, place = np.unique(codes, return_inverse=True)
        place = place.reshape(codes.shape)
        for c in single.tolist():
            if c not in self.char_p:
                self.char_p[c] = math.exp(sum([self.lattice.byte_log_p[b] for b in chr(c).encode()]))
        by_char = np.array([self.char_p[c] for c in single.tolist()])[place]
        wide = codes.astype(np.uint64)
        # numbers[k][i]: the piece of k + 1 characters that starts at i, or -1
        numbers, chances = [], []
        h = np.zeros(codes.shape, np.uint64)
        for k in range(min(n, self.lattice.longest)):
            h = _extended(h[: n - k], wide[k:])
            found = np.full(h.shape, -1)
            for shift, slot in self.slots:
                at = slot[self._slot(h, shift)]
                np.copyto(found, at, where=self.hashes[at] == h)
            numbers.append(found)
            chances.append(self.p[found])
        alpha = np.zeros((n + 1, len(texts)))
        alpha[0] = 1.0
        for j in range(1, n + 1):
            alpha[j] = alpha[j - 1] * by_char[j - 1]
            for k in range(min(j, len(chances))):
                alpha[j] += alpha[j - k - 1] * chances[k][j - k - 1]
        fits = alpha[n] > _LEAST
        with np.errstate(divide="ignore"):
            out = np.where(fits, np.log10(alpha[n]), np.nan)
        if times is None:
            return out
        beta = np.zeros((n + 1, len(texts)))
        beta[n] = np.where(fits, times / np.where(fits, alpha[n], 1.0), 0.0)
        for i in range(n - 1, -1, -1):
            beta[i] = beta[i + 1] * by_char[i]
            for k in range(min(n - i, len(chances))):
                beta[i] += beta[i + k + 1] * chances[k][i]
        for k, found in enumerate(numbers):
            i, w = np.nonzero(found >= 0)
            share = alpha[i, w] * chances[k][i, w] * beta[i + k + 1, w]
            self.counts += np.bincount(found[i, w], share, len(self.counts))
        share = alpha[:-1] * by_char * beta[1:]
        for c, total in zip(single.tolist(), np.bincount(place.ravel(), share.ravel(), len(single))):
            for b in chr(c).encode():
                self.by_byte[b] += total
        return out


def _extended(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings from those of all but the last character."""
    return mix(h + codes + np.uint64(1))


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum([math.exp(t - top) for t in terms]))


def piece_scores(counts: dict[str, float], model: str, smoothing: float = 0.1) -> tuple[Lattice, float]:
    """Lattice and log10 probability of the end, from counts of pieces and of the end."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=resolve(model))
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    usable = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    total = sum(counts.get(names[i], 0) + smoothing for i in usable) + counts.get(_END, 0) + smoothing
    log_p = {names[i]: math.log((counts.get(names[i], 0) + smoothing) / total) for i in usable}
    by_byte = [log_p.pop(f"<0x{b:02X}>", math.log(smoothing / total)) for b in range(256)]
    return Lattice(log_p, by_byte), math.log10((counts.get(_END, 0) + smoothing) / total)


def _words(text: bytes) -> list[bytes]:
    """Words as they are looked up, see looked_up()."""
    found = text.lower().split()
    return [w if len(w) <= 64 else b"\0" + hashlib.md5(w).digest() for w in found]


def looked_up(word: Column) -> Column:
    """The key of a word: itself, or a digest of more than 64 bytes."""
    digest = F.concat(F.lit(bytearray(b"\0")), F.unhex(F.md5(word)))
    return F.when(F.octet_length(word) <= 64, word).otherwise(digest)


def word_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """(word binary, trained, used): occurrences in training rows and in all rows (id, text, trains)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: Counter = Counter()
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = list(trained.keys() | held.keys())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.binary()),
                    pa.array([trained[w] for w in words], pa.int64()),
                    pa.array([trained[w] + held[w] for w in words], pa.int64()),
                ],
                names=["word", "trained", "used"],
            )
            trained.clear()
            held.clear()
            return out

        for batch in slices(batches):
            for text, trains in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                (trained if trains else held).update(text.lower().split())
                if len(trained) + len(held) > most:
                    yield rows()
        if trained or held:
            yield rows()

    counted = docs.select("text", "trains").mapInArrow(count, "word binary, trained long, used long")
    return counted.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("used").alias("used"))


def piece_counts(words: DataFrame, model: str) -> dict[str, int]:
    """Pieces of all training words; the driver gets one row for each piece of the vocabulary at most."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=resolve(model))
        total = np.zeros(sp.get_piece_size())
        for batch in batches:
            texts = [w.decode() for w in batch.column(0).to_pylist()]
            pieces = sp.encode(texts, num_threads=1)
            sizes = [len(p) for p in pieces]
            ids = np.fromiter((i for p in pieces for i in p), np.int64, sum(sizes))
            total += np.bincount(ids, np.repeat(batch.column(1).to_numpy(), sizes), len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([sp.id_to_piece(int(i)) for i in seen], pa.string()), pa.array(total[seen].astype(np.int64))],
            names=["piece", "n"],
        )

    rows = words.filter("trained > 0").select("word", "trained").mapInArrow(cut, "piece string, n long")
    return dict(rows.groupBy("piece").agg(F.sum("n").alias("n")).collect())


def expected_counts(words: DataFrame, lattice: Lattice) -> dict[str, float]:
    """Expected pieces of all training words under a lattice; the driver gets one row for each piece at most."""
    tables = words.sparkSession.sparkContext.broadcast((lattice.log_p, lattice.byte_log_p))

    def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Expectations(Lattice(*tables.value))
        for batch in batches:
            found.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        names = found.pieces + [f"<0x{b:02X}>" for b in range(256)]
        total = np.concatenate([found.counts, found.by_byte])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in seen], pa.string()), pa.array(total[seen])], names=["piece", "n"]
        )

    rows = words.filter("trained > 0").select("word", "trained").mapInArrow(expect, "piece string, n double")
    return dict(rows.groupBy("piece").agg(_exact_sum(F.col("n"), 12).cast("double").alias("n")).collect())


def _exact_sum(x: Column, decimals: int = 10) -> Column:
    """A sum that is the same in any order."""
    return F.sum(x.cast(f"decimal(28,{decimals})"))


def fitted(words: DataFrame, ends: int, model: str, refined: int) -> tuple[Lattice, float]:
    """Lattice and log10 probability of the end, learned from word_counts() and the number of texts."""
    lattice, end_score = piece_scores(piece_counts(words, model) | {_END: ends}, model)
    for _ in range(refined):
        lattice, end_score = piece_scores(expected_counts(words, lattice) | {_END: ends}, model)
    return lattice, end_score


def scored_words(words: DataFrame, lattice: Lattice) -> DataFrame:
    """(key, trained, used, score): each word's key, counts and log10 probability."""
    tables = words.sparkSession.sparkContext.broadcast((lattice.log_p, lattice.byte_log_p))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Expectations(Lattice(*tables.value))
        for batch in slices(batches, 10_000):
            s = own.scores(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(s, pa.float64())],
                names=["key", "trained", "used", "score"],
            )

    keyed = words.select(looked_up(F.col("word")).alias("key"), "trained", "used", "word")
    return keyed.mapInArrow(score, "key binary, trained long, used long, score double")


def score_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = "piece_bpe_32k.model",
    table_size: int = 150_000,
    refined: int = 3,
) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every text.

    Learned from the rows whose crc32(id) mod 10 is not 0.  ``refined`` is the
    number of rounds that fit the scores over all words' segmentations.
    """
    spark = df.sparkSession
    part = id_bucket(id_col, 10)
    docs = df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(part != 0, F.lit(False)).alias("trains"),
        F.coalesce(part == 0, F.lit(False)).alias("held_out"),
    )
    words = cut_lineage(word_counts(docs))
    ends = docs.filter("trains").count()
    known = words.agg(F.sum("trained"), F.count_if(F.col("trained") > 0)).first()
    n, v = (known[0] or 0) + ends, known[1] + (ends > 0)
    floor = math.log10(n + 0.1 * (v + 1))
    lattice, end_score = fitted(words, ends, model, refined)
    scored = cut_lineage(scored_words(words, lattice))
    # the least power of two that no more than table_size words reach
    power = F.floor(F.log2("used")).cast("int").alias("power")
    reach, least = 0, 62
    for p, c in sorted(scored.groupBy(power).agg(F.count(F.lit(1))).collect(), reverse=True):
        reach += c
        if reach > table_size:
            break
        least = p
    frequent = F.col("used") >= 2**least
    head = scored.filter(frequent).select("key", "trained", "score").collect()
    index = {bytes(r.key): k for k, r in enumerate(head)}
    shared = spark.sparkContext.broadcast(
        (
            index,
            np.array([math.log10(r.trained + 0.1) - floor for r in head] + [0.0]),
            np.array([r.score for r in head] + [0.0]),
            np.array([r.trained > 0 for r in head] + [False]),
        )
    )
    end_base = math.log10(ends + 0.1) - floor

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base, score, seen = shared.value
        uid = TaskContext.get().partitionId() << 33
        none = len(base) - 1
        for part in slices(batches):
            uids, words, times, sums = [], [], [], []
            first = uid
            for text in utf8(part.column(1)):
                own = _words(text)
                k = np.fromiter(map(index.get, own, repeat(none)), np.int64, len(own))
                known = int(np.count_nonzero(seen[k])) + (ends > 0)
                sums.append((len(own) + 1, known, base[k].sum() + end_base, score[k].sum() + end_score))
                rare = Counter([own[i] for i in np.flatnonzero(k == none)])
                words.extend(rare.keys())
                times.extend(rare.values())
                uids.extend([uid] * len(rare))
                uid += 1
            n_docs, n_rare = part.num_rows, len(words)
            # a document's own row meets no word: words hold no space
            words.extend(b" %d" % u for u in range(first, uid))
            nulls = lambda kind: pa.nulls(n_rare, kind)
            columns = list(zip(*sums))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uids + list(range(first, uid)), pa.int64()),
                    pa.array(words, pa.binary()),
                    pa.array(times + [0] * n_docs, pa.int64()),
                    pa.concat_arrays([nulls(part.column(0).type), part.column(0)]),
                    pa.concat_arrays([nulls(pa.bool_()), part.column(2)]),
                    *(
                        pa.concat_arrays([nulls(t), pa.array(c, t)])
                        for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))
                    ),
                ],
                names=["uid", "word", "times", "id", "held_out", "n_tokens", "n_known", "base", "score"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    found = docs.select("id", "text", "held_out").mapInArrow(
        look_up,
        f"uid long, word binary, times long, id {id_type}, held_out boolean, n_tokens long, n_known long, "
        "base double, score double",
    )
    rare = scored.filter(~frequent).select(F.col("key").alias("word"), "trained", F.col("score").alias("w_score"))
    joined = found.join(rare.hint("shuffle_merge"), "word", "left")
    w_base = F.log10(F.col("trained") + 0.1) - floor
    out = joined.groupBy("uid").agg(
        F.max("id").alias("id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("trained") > 0, F.col("times"))), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(_exact_sum(w_base * F.col("times")).cast("double"), F.lit(0.0))).alias("base_score"),
        (F.max("score") + F.coalesce(_exact_sum(F.col("w_score") * F.col("times")).cast("double"), F.lit(0.0))).alias("score"),
    )
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
