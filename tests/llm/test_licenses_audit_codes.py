"""License scan, filter audit and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from paceforge.llm import filter_audit, license_rules, license_scan, vector_codes
from tests.llm import corpus

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICES = [
    "Licensed under the Apache License, Version 2.0. All rights reserved.",
    "This work is licensed under the GNU General Public License, version 3.",
    "CC BY-NC 4.0; cc-by cc by; CC\nBY-SA",
    "Released under the MIT License. Copyright (c) 2019 2020 somebody",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "general  public\tlicense GENERAL PUBLIC LICENSE v2 all rights reserved",
    "mit freundlichen Grüßen, cc bye, acc by, généralpublic license",
    "cc by” cc“ by",
]


def _texts():
    rng = random.Random(4)
    rows = corpus.documents()
    for k in range(60):
        parts = [corpus.prose(rng, "en", 12) if rng.random() < 0.5 else rng.choice(NOTICES) for _ in range(rng.randint(1, 6))]
        rows.append((6000 + k, rng.choice(("\n", " ", ", ")).join(parts), "en", "s2", 0))
    return rows + [(7000 + k, t, "en", "s2", 0) for k, t in enumerate([*NOTICES, "x" * 2_000_000, "cc by " * 200_000])]


def _plain_scan(text):
    """Every rule over the whole text, and every pair of detections compared."""
    words = WORD.findall(corpus.lower(text or ""))
    places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    joined, found = " ".join(words), []
    word_at = {0: 0} | {m.end(): k + 1 for k, m in enumerate(re.finditer(" ", joined))}
    for rule, (tier, label, keywords, pattern) in enumerate(license_rules.parsed()):
        for m in re.finditer(f"(?<![^ ])(?:{pattern})(?![^ ])", joined):
            assert any(f" {w} " in f" {m[0]} " for w in keywords)
            found.append((word_at[m.start()], word_at[m.start()] + m[0].count(" "), tier, rule, label))
    kept = []
    for d in found:
        inside = [o for o in found if o != d and o[0] <= d[0] and o[1] >= d[1] and (o[2] < d[2] or o[2] == d[2] and ((o[0], o[1]) != (d[0], d[1]) or o[3] < d[3]))]
        if not inside:
            kept.append(d)
    kept = [d for d in kept if d[2] < 4 or not any(o[2] < 4 and o[0] <= d[1] and o[1] >= d[0] for o in kept)]
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(d[4] for d in kept)})
    score = max([license_scan.CONFIDENCE[d[2]] for d in kept] + [0.75 if base else 0.0])
    at = [k for k, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), score), sorted(d[:4] for d in kept)


def test_license_scan_equals_every_rule_on_every_text(spark):
    rows = _texts()
    docs = corpus.frame(spark, rows).selectExpr("*", "1 AS id", "'x' AS labels", "2 AS score")
    out = license_scan.license_scan(docs)
    assert license_scan.license_scan(docs.limit(0)).count() == 0
    plain = {}
    expected = Counter()
    for r in rows:
        if r[1] is not None and len(r[1]) > 1_000_000:
            continue
        if r[1] not in plain:
            plain[r[1]] = _plain_scan(r[1])
        expected[(r[0], *plain[r[1]][0], tuple(plain[r[1]][1]))] += 1
    got = Counter()
    long_ones = {}
    for r in out.collect():
        if r.doc_id in (7009, 7010):
            long_ones[r.doc_id] = r
            continue
        got[(r.doc_id, *r[1:8], tuple(sorted((d.first_word, d.last_word, d.tier, d.rule) for d in r.detections)))] += 1
    assert got == expected
    assert long_ones[7009].n_words == 1 and long_ones[7010].n_base == 200_000 and long_ones[7010].last_word == 399_998


def test_license_rules_are_bounded_and_meet_real_notices():
    rules = license_rules.parsed()
    assert len(rules) > 250 and all(re._parser.parse(p).getwidth()[1] < license_scan.REACH for *_, p in rules)
    found = [_plain_scan(t)[0][5] for t in NOTICES]
    assert found == [
        "apache-2.0,reserved", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0,cc-by-sa", "copyright,mit", "bsd-2-clause", "gpl-2.0+",
        "gpl,gpl-2.0,reserved", "", "",
    ]


def _plain_audit(rows, labels):
    marks: dict = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or quality == 1, bad or toxic == 1)
    judged = []
    for i, text, _, source, *_ in rows:
        t = text or ""
        w = corpus.words(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": i is not None and any((o[1] or "") == t and o[0] is not None and o[0] < i for o in rows),
        }
        judged.append((source or "", {f for f, x in fails.items() if x}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        shapley: Counter = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [j for j in own if f in j[1] and not j[1] & before]
                shapley[f] += len(removed)
                out[(part, "".join(order), step)] = [
                    sum(not j[1] & {*before, f} for j in own), len(removed), sum(f in j[1] and bool(j[1] & before) for j in own),
                    sum(j[1] == {f} for j in own), sum(j[2] for j in removed), sum(j[3] for j in removed),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filter_audit_equals_every_order_played_through(spark):
    rows = corpus.documents(n=60)
    shared = "Equal words of a text that many rows share, " + corpus.prose(random.Random(1), "en", 80)
    rows += [(900 - k, shared, "en", f"s{k % 4}" if k % 5 else None, 0) for k in range(40)]
    rows += [(900, shared, "en", "s0", 0), (861, shared, "en", "s1", 0), (861, shared, "en", "s1", 0), (None, shared, "en", "s1", 0)]
    marks = [(r[0], r[0] % 2, r[0] % 3 // 2) for r in rows if r[0] is not None and r[0] % 4] + [(7, 0, 1), (7, 1, None), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "1 AS id", "2 AS n")
    docs = corpus.frame(spark, rows).selectExpr("*", "1 AS id", "2 AS n", "3 AS mask", "true AS good")
    audit = lambda d: filter_audit.interaction_audit(filter_audit.cells(filter_audit.text_failures(d), labels))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit(docs).collect()}
    assert got == _plain_audit(rows, marks)
    assert audit(docs.limit(0)).count() == 0
    assert audit(docs.filter("doc_id = 899").withColumn("text", docs.lang)).count() == 600
    with pytest.raises(ValueError):
        filter_audit.mask_steps(spark, "AAB")
    two = filter_audit.interaction_audit(spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 0, 2, 0, 0)], "part string, mask int, n long, good long, toxic long"), "XY")
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.shapley) for r in two.collect()) == [
        ("XY", 1, 2, 5, 0, 5), ("XY", 2, 2, 0, 5, 5), ("YX", 1, 2, 5, 0, 5), ("YX", 2, 2, 0, 5, 5),
    ]


def _plain_codes(rows, parts, entries, rounds):
    kept = [r for r in rows if r[1] and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [(*r, [max(-(1 << 24), min(1 << 24, math.floor(1024 * x))) for x in r[1]]) for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * w : (p + 1) * w]) for p in range(parts)]
    books = [[cut(r[3])[p] for r in kept[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own: dict = {}
            for r in kept:
                own.setdefault(nearest(p, cut(r[3])[p])[1], []).append(cut(r[3])[p])
            new.append([tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else e for k, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(r[0], r[2], [nearest(p, cut(r[3])[p]) for p in range(parts)]) for r in kept]
    errors = [sum(d for d, _ in found) for *_, found in coded]
    of_label: Counter = Counter()
    for (_, label, _), e in zip(coded, errors):
        of_label[label] += e
    return [(i, "".join(f"{k:02x}" for _, k in found), e, of_label[label], digest) for (i, label, found), e in zip(coded, errors)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_codes_equal_plain_refinement(spark, kind):
    rng = np.random.default_rng(3)
    vectors = [[float(np.float32(x)) for x in rng.normal(0, 0.3, 8)] for _ in range(90)]
    rows = [(int(i), v, [None, "a", "b"][i % 3]) for i, v in enumerate(vectors)]
    rows += [(200 + k, rows[k % 7][1], "a") for k in range(60)]  # equal vectors, a hot label
    rows += [(3, vectors[5], "b"), (3, vectors[5], "b"), (None, vectors[6], None)]
    rows += [(300, None, "a"), (301, [], "a"), (302, [0.1, None] * 4, "a"), (303, [float("nan")] * 8, "a"), (304, [float("inf")] + [0.0] * 7, "a")]
    rows += [(305, [0.5] * 4, "b"), (306, [0.5] * 7, "b"), (307, [0.0] * 8, "c"), (308, [3e8] + [-3e8] * 7, "c")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string").selectExpr("*", "1 AS id", "'x' AS code", "2 AS vector")
    for entries, most in ((16, 100), (256, 100), (16, 1)):  # the last one deals labels with salts
        got = vector_codes.vector_codes(df, entries=entries, rounds=3, broadcast_rows=most).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(map(tuple, got), key=key) == sorted(_plain_codes(rows, 4, entries, 3), key=key)
    assert vector_codes.vector_codes(df.limit(0)).count() == 0
    assert vector_codes.vector_codes(df.filter("vec_id IN (300, 303, 306)")).count() == 0
    with pytest.raises(ValueError):
        vector_codes.vector_codes(df, entries=300)


def test_va_file_bounds_hold():
    rng = np.random.default_rng(8)
    for scale in (2, 600, 1 << 24):
        entries = rng.integers(-scale, scale + 1, (70, 5))
        x = np.concatenate([rng.integers(-scale, scale + 1, (400, 5)), entries[:20]])
        exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        entry, least, refined = vector_codes.VaFile(entries).nearest(x)
        assert (entry == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all() and refined < exact.size / 2


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_vector_codes"])
def test_equals_its_sql(spark, name):
    from paceforge.llm.registry import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(found.fetchall())
