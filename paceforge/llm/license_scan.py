"""License scan by ordered signature rules.

Each whole text becomes its words, A-Z lower-cased, joined by single spaces.  One
automaton over the rules' keywords reads it once; only rules whose keyword occurs
run, and only around its places, so a text without keywords costs one reading
and a long one no more than its places.  Of the detections, those contained in
one of a better or the same tier are dropped (of equal ones the earlier rule
stays), and clues that overlap any better one are too.

The base phrases are keywords as well: their places are all counted, and their
labels stay whatever the rules find.

Edge cases: a null or empty text has no words and no labels, and a score of 0.
Rows with equal ids are scanned one by one; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.common import slices, table, utf8
from paceforge.llm.license_rules import parsed

#: Phrases of the base, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: How sure a detection of each tier is; a base phrase counts as a name.
CONFIDENCE = (1.0, 0.95, 0.9, 0.75, 0.4)
_NAME, _CLUE = 3, 4
#: Characters on both sides of a keyword in which its rules are tried; no match is longer.
REACH = 1024

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TABLE).split()


class Scanner:
    """Compiled rules and the automaton over their keywords."""

    def __init__(self, rules: list[tuple[int, str, tuple[str, ...], str]] | None = None) -> None:
        import ahocorasick

        self.rules = [
            (tier, label, re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])")) for tier, label, _, pattern in (parsed() if rules is None else rules)
        ]
        self.rules_of: dict[str, list[int]] = {}
        for k, (_, _, keywords, _) in enumerate(parsed() if rules is None else rules):
            for word in keywords:
                self.rules_of.setdefault(word, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for word in {*self.rules_of, *(phrase for phrase, _ in BASE)}:
            self.automaton.add_word(f" {word} ", word)
        self.automaton.make_automaton()

    def places(self, text: str) -> dict[str, list[int]]:
        """Start of each keyword in a text of words between single spaces, itself between two."""
        found: dict[str, list[int]] = {}
        for end, word in self.automaton.iter(text):
            found.setdefault(word, []).append(end - len(word))
        return found

    def matches(self, text: str, places: dict[str, list[int]]) -> list[tuple[int, int, int, int]]:
        """(start, -end, tier, rule) in characters, of every rule around its keywords."""
        starts: dict[int, list[int]] = {}
        for word, at in places.items():
            for k in self.rules_of.get(word, ()):
                starts.setdefault(k, []).extend(at)
        out = []
        for k, at in starts.items():
            tier, _, pattern = self.rules[k]
            spans: list[list[int]] = []
            for a in sorted(at):
                if spans and a - REACH <= spans[-1][1]:
                    spans[-1][1] = a + REACH
                else:
                    spans.append([a - REACH, a + REACH])
            for a, b in spans:
                a, b = text.rfind(" ", 0, max(a, 1)), text.find(" ", b)  # a word is tried whole or not at all
                out += [(m.start(), -m.end(), tier, k) for m in pattern.finditer(text, a, b if b >= 0 else len(text))]
        return out


def surviving(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections (start, -end, tier, rule) that no other suppresses, in order."""
    ends = [0] * len(CONFIDENCE)  # furthest end so far, of each tier
    kept = []
    for d in sorted(found):
        end, tier = -d[1], d[2]
        if max(ends[: tier + 1]) < end:
            kept.append(d)
        ends[tier] = max(ends[tier], end)
    solid = [d for d in kept if d[2] < _CLUE]
    firsts, reach = [d[0] for d in solid], list(accumulate((-d[1] for d in solid), max))

    def overlaps(d: tuple[int, int, int, int]) -> bool:
        k = bisect_right(firsts, -d[1] - 1)  # those that start before its end
        return k > 0 and reach[k - 1] > d[0]

    return [d for d in kept if d[2] < _CLUE or not overlaps(d)]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(text: bytes, rules: Scanner) -> dict:
    """All that is found in one text; positions count words from 0."""
    words = words_of(text)
    padded = f" {b' '.join(words).decode()} "
    places = rules.places(padded) if words else {}
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base": [], "detections": []}
    if not places:
        return out
    spaces = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le"), np.uint32) == 32)
    base = [(at, label) for phrase, label in BASE for at in places.get(phrase, ())]
    if base:
        word_at = np.searchsorted(spaces, [at for at, _ in base]) - 1
        out |= {"n_base": len(base), "first_word": int(word_at.min()), "last_word": int(word_at.max()), "base": sorted({label for _, label in base})}
    for a, b, tier, k in surviving(rules.matches(padded, places)):
        first, after = np.searchsorted(spaces, [a, -b]) - 1
        out["detections"].append((rules.rules[k][1], int(first), int(after), tier, k))
    return out


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every text.

    A detection has its label, its first and last word, its tier and the rule's
    place; ``score`` is the confidence of the surest, or of a base phrase.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = scanner()
        for part in slices(batches):
            found = [scan(t, rules) for t in utf8(part.column(1))]
            labels = [sorted({*f["base"], *(d[0] for d in f["detections"])}) for f in found]
            sure = [max([CONFIDENCE[d[3]] for d in f["detections"]] + [CONFIDENCE[_NAME] if f["base"] else 0.0]) for f in found]
            detections = [
                [{"label": d[0], "first_word": d[1], "last_word": d[2], "tier": d[3], "rule": d[4]} for d in f["detections"]] for f in found
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0)]
                + [pa.array([f[c] for f in found], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
                + [
                    pa.array([",".join(f["base"]) for f in found]),
                    pa.array([",".join(x) for x in labels]),
                    pa.array(sure, pa.float64()),
                    pa.array(detections, _DETECTIONS),
                ],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " detections array<struct<label: string, first_word: long, last_word: long, tier: int, rule: int>>",
    )
    return out.withColumnRenamed("id", id_col)


_DETECTIONS = pa.list_(
    pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("tier", pa.int32()), ("rule", pa.int32())])
)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")
