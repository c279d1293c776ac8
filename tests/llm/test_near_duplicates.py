from __future__ import annotations

import numpy as np
import pytest

from paceforge.llm import buckets, minhash, shingles, vectors
from tests.llm import corpus


def test_matches_all_pairs(spark):
    rows = corpus.documents()
    found = minhash.near_duplicates(corpus.frame(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = corpus.near_components(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id]
            assert r.n_shingles == len(corpus.shingles(texts[r.doc_id]))
            assert r.kept == (r.doc_id == r.component_id)


def test_split_blocks_give_the_same(spark):
    rows = corpus.documents()
    df = corpus.frame(spark, rows)
    small = minhash.near_duplicates(df, block_rows=3, block_bytes=4000)
    assert sorted(map(str, small.collect())) == sorted(map(str, minhash.near_duplicates(df).collect()))


def test_empty_table_and_clashing_columns(spark):
    assert minhash.near_duplicates(corpus.frame(spark, [])).count() == 0
    rows = corpus.documents(n=20)
    df = corpus.frame(spark, rows).selectExpr("*", "1 AS id", "2 AS kept", "3 AS component_id", "'x' AS keys")
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    expected = corpus.near_components(rows)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(expected.values()))
    assert ids.count(None) == 1


def test_one_id_with_two_texts_hangs_together(spark):
    a, b = corpus.prose(corpus.random.Random(1), "en", 50), corpus.prose(corpus.random.Random(2), "en", 50)
    rows = [(1, a, "", "", 0), (2, b, "", "", 0), (5, a, "", "", 0), (5, b, "", "", 0)]
    found = minhash.near_duplicates(corpus.frame(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (5, 1)}


def test_texts_of_one_id_are_each_compared(spark):
    rng = corpus.random.Random(3)
    a, b = corpus.prose(rng, "en", 300), corpus.prose(rng, "en", 300)
    rows = [(1, a, "", "", 0), (1, b, "", "", 0), (7, b + " more", "", "", 0), (8, a + " more", "", "", 0), (1, b, "", "", 0)]
    rows += [(20 + k, corpus.prose(rng, "en", 40), "", "", 0) for k in range(3)] + [(20, None, "", "", 0)] * 4
    found = minhash.near_duplicates(corpus.frame(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = corpus.near_components(rows)
    assert expected[7] == expected[8] == 1
    assert all(r.component_id == expected[r.doc_id] for r in found)


def test_hot_groups_over_many_blocks(spark):
    """Near copies, two looser families and strangers that share bands: blocks of a few rows give what all pairs give."""
    rng = corpus.random.Random(12)
    base = corpus.prose(rng, "en", 80).split()
    rows = []
    for k in range(90):
        edits = {rng.randrange(80) for _ in range(k % 4)} if k < 60 else set(range(0, 10)) | {rng.randrange(80) for _ in range(k % 2)}
        rows.append((k, " ".join(f"e{k if k % 3 else 0}x" if j in edits else w for j, w in enumerate(base)), "", "", 0))
    rows += [(200 + k, corpus.prose(rng, "en", 80), "", "", 0) for k in range(20)]
    expected = corpus.near_components(rows)
    df = corpus.frame(spark, rows)
    for block in (3, 2048):
        found = minhash.near_duplicates(df, block_rows=block, block_bytes=1 << 20).collect()
        assert {r.doc_id: r.component_id for r in found} == expected, block


def test_ids_must_be_whole_numbers(spark):
    df = spark.createDataFrame([("a", "text", [1.0], 1)], "doc_id string, text string, embedding array<double>, label int")
    with pytest.raises(ValueError):
        minhash.near_duplicates(df)
    with pytest.raises(ValueError):
        vectors.vector_duplicates(df, id_col="doc_id")


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:2000], rng.integers(0, 2**63, 1000, dtype=np.uint64)]))
    true = shingles.overlap(a, b) / (len(a) + len(b) - shingles.overlap(a, b))
    packed = minhash.pack_low_bits(shingles.minima([a, b], 512))
    assert minhash.estimate(packed[0], packed[1:])[0] == pytest.approx(true, abs=0.08)


def test_threshold_is_exact():
    a, b = np.arange(100, dtype=np.uint64), np.arange(8, 108, dtype=np.uint64)  # 92 of 108: 0.8518
    assert shingles.linked(a, b, 85)
    assert not shingles.linked(a, b + np.uint64(1), 85)  # 91 of 109: 0.834
    assert not shingles.linked(a[:0], a[:0], 85)


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 130)] + [(7, k) for k in range(8, 40)] + [(3, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.id: r.component for r in buckets.components(df).collect()}
    assert found == {k: 100 for k in range(100, 131)} | {k: 7 for k in range(7, 40)}


def _vectors():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(150):
        rows.append((k, rng.standard_normal(64).tolist(), k % 3))
    center = rng.standard_normal(64)
    for k in range(40):
        rows.append((200 + k, (center + 0.2 * rng.standard_normal(64)).tolist(), 1))
    rows += [(300 + k, center.tolist(), 1) for k in range(5)] + [(310, center.tolist(), 2), (311, (center * 3).tolist(), 1)]
    rows += [(400, None, 1), (401, [0.0] * 64, 1), (402, [float("nan")] + [1.0] * 63, 1), (403, [None] + [1.0] * 63, 1), (404, center.tolist(), None), (405, [], 1), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1), (None, center.tolist(), 1)]
    return rows


def test_vectors_match_all_pairs(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in vectors.vector_duplicates(df).collect() if r.vec_id is not None}
    usable = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            usable[i] = (np.array(v) / np.linalg.norm(v), label)
    links = [
        (a, b)
        for a in usable
        for b in usable
        if a < b and usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]) and usable[a][0] @ usable[b][0] >= 0.93
    ]
    component = corpus.component_of(links, found)
    assert len(found) == len(rows) - 1
    for i, r in found.items():
        assert r.n_links == sum(i in pair for pair in links), i
        assert r.component_id == component[i] and r.kept == (component[i] == i)


def test_vector_labels_of_any_type_and_infinite_components(spark):
    near = [1.0, 0.1, 0.0, 0.0]
    rows = [(1, near, "a b"), (2, near, "a b"), (3, near, "c"), (4, near, None), (5, near, "C"), (6, [1.0, 0.11, 0.0, 0.0], "a b")]
    rows += [(7, [float("inf"), 0.0, 0.0, 0.0], "a b"), (8, [float("-inf"), 1.0, 0.0, 0.0], "c"), (9, [float("inf"), 0.0, 0.0, 0.0], "a b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.vector_duplicates(df).collect()}
    alone = {i: (0, i) for i in (3, 4, 5, 7, 8, 9)}
    assert found == {1: (2, 1), 2: (2, 1), 6: (2, 1)} | alone
    struct = df.selectExpr("vec_id", "embedding", "struct(label, 1 AS n) AS label")
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.vector_duplicates(struct.filter("label.label IS NOT NULL")).collect()} == {
        k: v for k, v in found.items() if k != 4
    }


def test_vectors_of_one_id_are_each_compared(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6):
        a, b = rng.standard_normal(32), rng.standard_normal(32)
        rows += [(k, a.tolist(), 1), (k, b.tolist(), 1), (100 + k, (a + 0.01 * rng.standard_normal(32)).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label short").selectExpr("*", "1 AS id", "2 AS unit", "3 AS copies")
    found = vectors.vector_duplicates(df).collect()
    assert all((r.n_links, r.component_id) == (1, r.vec_id - 100) for r in found if r.vec_id >= 100)
    assert sorted(r.n_links for r in found if r.vec_id < 100) == [0] * 6 + [1] * 6


def test_table_plan_keeps_the_recall():
    near = vectors.same_cell(np.sqrt(2 - 2 * 0.93), 2.0)
    plans = [vectors.table_plan(n, 0.93, 2.0, 64.0, 1e-3) for n in (1, 1000, 10**5, 10**7)]
    assert [p[1] for p in plans] == sorted({p[1] for p in plans})
    for tables, projections in plans:
        assert (1 - near**projections) ** tables <= 1e-3
    rng = np.random.default_rng(2)
    d = rng.standard_normal((200_000,)) * np.sqrt(2 - 2 * 0.93)
    shift = rng.random(len(d)) * 2
    assert np.mean(np.floor(shift / 2) == np.floor((shift + d) / 2)) == pytest.approx(near, abs=5e-3)


def test_joined_finds_components():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    expected = corpus.component_of(list(zip(a.tolist(), b.tolist())), range(300))
    assert buckets.joined(300, a, b).tolist() == [expected[k] for k in range(300)]


def test_vector_blocks_and_empty_table(spark):
    df = spark.createDataFrame(_vectors(), "vec_id long, embedding array<double>, label int")
    one = sorted(map(str, vectors.vector_duplicates(df, block_rows=7).collect()))
    assert one == sorted(map(str, vectors.vector_duplicates(df).collect()))
    assert vectors.vector_duplicates(df.limit(0)).count() == 0


def test_long_texts_hash_like_short_ones():
    rng = corpus.random.Random(8)
    small = [corpus.prose(rng, "de", 40).encode() for _ in range(3)]
    huge = b" ".join([*small[:1], b"y" * 3_000_000, b"Z" * 3_000_000, *small[1:]]) + b" " + b"w " * 2_000_000
    data = np.frombuffer(huge, np.uint8)
    starts, ends = shingles.words(data)
    hashes = shingles.word_hashes(data, starts, ends)
    words = huge.lower().split()
    assert len(words) == len(hashes) and len(set(words)) == len(set(hashes.tolist()))
    seen: dict = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
    one = shingles.shingle_sets([small[0]])[0]
    assert shingles.overlap(one, shingles.shingle_sets([huge])[0]) >= len(one)
