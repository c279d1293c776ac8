from __future__ import annotations

import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from paceforge.llm import language_id, lm_score, packing, quality_classifier, quality_rules, tokens
from tests.llm import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")


def _texts(rows):
    return [(r[0], r[1]) for r in rows]


def _tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def _odd_texts(n=1500):
    rng = random.Random(3)
    return ["".join(rng.choice(" \n\t.,'sdabcÉéİΣς1²<|>\u0301!½　日\x1c\u00a0") for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    rows = corpus.documents() + [(5000 + k, t, "", "", 0) for k, t in enumerate(_odd_texts())]
    library = _tokenizer("byte_bpe_50k.json")
    docs = corpus.frame(spark, rows).selectExpr("*", "1 AS id", "2 AS n_tokens")
    found = tokens.count_tokens(docs, table_size=500, counter_size=800, worker_cache=300, sample_rows=400).collect()
    assert tokens.count_tokens(docs.limit(0)).count() == 0
    expected = Counter()
    for i, t in _texts(rows):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected[(i, len((t or "").encode()), n, n > 512)] += 1
    assert Counter(tuple(r) for r in found) == expected


def test_token_sample_reads_some_files(spark, tmp_path):
    where = str(tmp_path / "docs%20 folder")
    spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(20).write.parquet(where)
    docs = spark.read.parquet(where)
    some = tokens.sampled(docs, "text", 100, files=4)
    assert some.inputFiles() and some.rdd.getNumPartitions() <= 4
    assert 50 <= some.count() <= 160 and some.columns == ["text"]
    assert tokens.sampled(docs, "text", 5000, files=4).count() == 1000
    assert tokens.sampled(docs.groupBy("text").count(), "text", 5000, files=4).count() == 1000
    assert tokens.sampled(docs.filter("doc_id < 0"), "text", 50, files=4).count() == 0


def test_packing_round_trip(spark):
    rows = corpus.documents() + [(5000 + k, t, "", "", 0) for k, t in enumerate(_odd_texts())]
    rows = [r for r in rows if r[0] is not None and r[0] != 0]
    library = _tokenizer("word_bpe_49k.json")
    found = packing.pack_documents(corpus.frame(spark, rows), longest=256, with_ids=True, worker_cache=200).collect()
    pieces: dict = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in found}) == len(found)
    extra = corpus.frame(spark, rows).selectExpr("*", "1 AS id", "2 AS start", "3 AS ids")
    assert packing.pack_documents(extra, longest=256).count() == len(found)
    assert packing.pack_documents(extra.limit(0)).count() == 0
    for i, t in _texts(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids
        at = 0
        for r in own:
            assert r.start == at and r.offset == 0 and r.doc_tokens == len(ids)
            assert r.length <= 256 and r.length & (r.length - 1) == 0
            assert r.ids_crc32 == packing.zlib.crc32(bytes(r.ids))
            at += r.length


def test_piece_lengths():
    assert packing.piece_lengths(1, 4096) == [1]
    assert packing.piece_lengths(4096 * 2 + 13, 4096) == [4096, 4096, 8, 4, 1]
    with pytest.raises(ValueError):
        packing.pack_documents(None, longest=100)


def _plain_counts(text):
    w = corpus.words(text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    repeated = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if corpus.WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def test_quality_rules_counts_and_verdicts(spark):
    noise = os.urandom(6000).hex()
    rows = corpus.documents() + [(4000, " ".join(noise[k : k + 7] for k in range(0, 12000, 7)), "", "", 0), (4001, "again and again we say so " * 40, "", "", 0)]
    found = {r.doc_id: r for r in quality_rules.quality_rules(corpus.frame(spark, rows)).collect()}
    for i, t in _texts(rows):
        if i is not None:
            r = found[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _plain_counts(t), i
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert not found[4001].kept
    assert found[1000].kept and found[2009].kept
    assert not quality_rules.within_bands(5000, 0.1, 0.0)
    assert not quality_rules.within_bands(5000, 0.95, 0.0)
    assert not quality_rules.within_bands(5000, 0.5, 0.6)
    assert quality_rules.within_bands(100, 1.5, 0.0)
    assert quality_rules.quality_rules(corpus.frame(spark, [])).count() == 0


def test_quality_verdicts_by_a_plain_version(spark):
    import zstandard

    def ratio(part):
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(part)) / len(part)

    rows = corpus.documents() + [(7000, "a b c d e f g " * 200_000, "", "", 0)]
    extra = corpus.frame(spark, rows).selectExpr("*", "1 AS id", "2 AS kept", "3 AS ratio")
    found = {r.doc_id: r for r in quality_rules.quality_rules(extra).collect()}
    for i, t in _texts(rows):
        data = (t or "").encode()
        fits = True
        if data:
            for least, low, high in quality_rules.BANDS:
                if len(data) >= least:
                    limits = low, high
            fits = limits[0] <= ratio(data) <= limits[1]
            n = quality_rules.CHUNK
            chunks = [data[k : k + n] for k in range(0, len(data) - n + 1, n)]
            chunks += [data[-n:]] if chunks and len(data) % n else []
            odd = [not quality_rules.CHUNK_LOW <= ratio(c) <= quality_rules.CHUNK_HIGH for c in chunks]
            fits = fits and sum(odd) <= quality_rules.CHUNK_SHARE * len(odd)
        assert found[i].kept == (fits and not found[i].base_failed), i
    assert {r.kept for r in found.values()} == {True, False}


def test_quality_rules_judge_the_tail(spark):
    rng = corpus.random.Random(4)
    clean = corpus.prose(rng, "en", 2000).encode()[: quality_rules.CHUNK].decode()
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+-/!?;", k=7)) for _ in range(125))
    rows = [(1, clean + noise, "", "", 0), (2, clean + clean[:500][::-1], "", "", 0), (3, clean, "", "", 0), (4, clean[:-1], "", "", 0)]
    found = {r.doc_id: r for r in quality_rules.quality_rules(corpus.frame(spark, rows)).collect()}
    low, high = quality_rules.BANDS[3][1:]
    assert low <= found[1].ratio <= high and not found[1].base_failed
    assert found[1].odd_chunks == 0.5 and not found[1].kept
    assert [found[i].odd_chunks for i in (2, 3, 4)] == [0.0] * 3 and found[3].kept


def test_quality_classifier_on_held_out(spark):
    rows = corpus.documents(n=400)
    rows = [r for r in rows if r[0] is None or r[0] < 400 or r[0] >= 1000]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 4 else 1) for i in range(400)], "doc_id long, quality int")
    docs = corpus.frame(spark, rows)
    model = quality_classifier.train(docs, labels)
    found = [r for r in quality_classifier.score_quality(docs, model).collect()]
    assert len(found) == len(rows)
    held = [r for r in found if r.held_out and r.doc_id < 400]
    assert all(r.held_out == (corpus.bucket(r.doc_id, 3) == 1) for r in found if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 5 != 4) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    kept = quality_classifier.keep_good(docs.selectExpr("*", "1 AS score"), model)
    assert kept.columns[-1] == "score" and kept.count() == sum(r.predicted for r in found)


def test_quality_scores_by_a_plain_version(spark):
    import zstandard

    rows = corpus.documents()
    docs = corpus.frame(spark, rows).selectExpr("*", "1 AS id", "2 AS predicted")
    model = quality_classifier.train(docs, corpus.labels(spark, rows))

    def size(part, content):
        d = zstandard.ZstdCompressionDict(content)
        return len(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_dict_id=False).compress(part))

    found = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, model).collect()}
    prior = math.log(model.prior / (1 - model.prior))
    for i, t in _texts(rows):
        data = (t or "").encode()
        x = prior
        if data:
            chunks = [data[k : k + model.chunk] for k in range(0, len(data), model.chunk)]
            gain = sum(size(c, model.bad) - size(c, model.good) for c in chunks) / len(data)
            x += (model.slope * gain + model.offset) * len(data) / (len(data) + quality_classifier.HALF_WEIGHT)
        assert found[i] == pytest.approx(1 / (1 + math.exp(-x)), rel=1e-9), i


@pytest.mark.parametrize("n", [1, 2, 5])
def test_quality_classifier_with_few_labels(spark, n):
    rng = corpus.random.Random(n)
    good, bad = ([[f(rng, "en", 150).encode()] for _ in range(n)] for f in (corpus.prose, corpus.junk))
    scorer = quality_classifier.Scorer(quality_classifier.fit(good, bad))
    one, other = (scorer.score(f(rng, "en", 150).encode()) for f in (corpus.prose, corpus.junk))
    assert one > other and (n < 5 or one > 0.5 > other)


def test_quality_classifier_without_labels(spark):
    docs = corpus.frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality_classifier.score_quality(docs, quality_classifier.train(docs, none)).collect()
    assert {r.score for r in found} == {0.5}
    empty = corpus.frame(spark, [])
    assert quality_classifier.score_quality(empty, quality_classifier.train(empty, none)).count() == 0


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    codes, labels = rng.integers(0, 257, (5, 7)), rng.integers(0, 3, 5)
    t = language_id._Trainer(3, 4, 1)
    kept = {k: v.copy() for k, v in t.p.items()}

    def loss(p):
        t.p = {k: v.copy() for k, v in p.items()}
        return t.step(codes, labels, 0.0)

    # after one step from zero moments, the first moment is a tenth of the (clipped) gradient
    loss(kept)
    grad = {k: m / 0.1 for k, m in t.m.items()}
    for name in ("Ef", "Uf", "cf", "Ub", "V", "v"):
        at = np.unravel_index(int(np.abs(grad[name]).argmax()), grad[name].shape)
        step = 1e-5
        up, down = ({k: v.copy() for k, v in kept.items()} for _ in range(2))
        up[name][at] += step
        down[name][at] -= step
        assert (loss(up) - loss(down)) / (2 * step) == pytest.approx(grad[name][at], rel=2e-3, abs=1e-6)


def test_language_id_on_held_out(spark):
    rows = corpus.documents(n=400)
    docs = corpus.frame(spark, rows)
    net = language_id.train(docs)
    found = language_id.identify(docs, net).collect()
    assert len(found) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in found if r.held_out and r.doc_id < 400]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9
    by_id = {r.doc_id: r for r in found}
    for odd in (2000, 2001, 2002, 2006, 3000):
        assert by_id[odd].lang_pred == "und" and by_id[odd].score == 0
    assert all(0 <= r.score <= 1 for r in found)
    kept = language_id.keep_identified(docs.selectExpr("*", "1 AS lang_pred"), net)
    assert kept.columns[-1] == "lang_pred" and 0 < kept.count() < len(rows)


def test_samples_take_each_key_once(spark):
    from paceforge.llm.sampling import first_by_hash, labelled_pieces

    rows = [(k % 40 if k % 3 else 0, f"text {k % 40 if k % 3 else 0}", "en" if k % 2 else "de", "", 0) for k in range(3000)]
    docs = corpus.frame(spark, rows)
    found = first_by_hash(docs, "lang", "doc_id", 5).collect()
    assert len(found) == len({(r.lang, r.doc_id) for r in found}) == 10
    pieces = labelled_pieces(docs, None, "lang", docs.doc_id >= 0, 50, 4, 128)
    assert len(pieces) == len(set(pieces)) == 41  # the id 0 has both labels


def test_language_id_without_training_rows(spark):
    docs = corpus.frame(spark, [(1, "some text", None, "s", 0), (2, None, None, None, None)])
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(docs)).collect()} == {"und"}
    empty = corpus.frame(spark, [])
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_network_by_a_plain_recurrence():
    net = language_id.fit([("a", b"aaa bab aab " * 9), ("b", b"xyz zzy yxx " * 9)], steps=20, window=16)
    size = net.recurrent[0].shape[0]

    def run(d, codes):
        h, out = np.zeros(size), []
        for c in codes:
            x, a = net.inputs[d][c].astype(float), h @ net.recurrent[d]
            z, r = (1 / (1 + np.exp(-(x[k * size : (k + 1) * size] + a[k * size : (k + 1) * size]))) for k in (0, 1))
            new = np.tanh(x[2 * size :] + r * (a[2 * size :] + net.bias[d]))
            h = new + z * (h - new)
            out.append(h)
        return out

    text = b"aab zyx!"  # one window, filled up
    codes = list(text) + [language_id.PAD] * (net.window - len(text))
    ahead, back = run(0, codes), run(1, codes[::-1])[::-1]
    logits = np.array([np.concatenate(p) @ net.output + net.output_bias for p in zip(ahead, back)])
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert language_id.predict(net, [text])[0] == pytest.approx(p[: len(text)].mean(axis=0), abs=1e-4)


def test_whole_texts_are_read():
    """A text's distribution is the mean over all its windows."""
    net = language_id.fit([("a", b"aaa bab aab " * 9), ("b", b"xyz zzy yxx " * 9)], steps=60)
    long = b"aab aba baa " * 400 + b"zyx xyy zzx " * 1200
    p = language_id.predict(net, [long, b"", b"aab"])
    assert p[0].argmax() == 1 and p[0].sum() == pytest.approx(1, abs=1e-4)
    assert p[1].sum() == 0


def test_lm_scores(spark):
    rows = corpus.documents()
    docs = corpus.frame(spark, rows)
    found = lm_score.score_texts(docs, table_size=50).collect()
    assert len(found) == len(rows)
    counts, ends = Counter(), 0
    for i, t in _texts(rows):
        if i is not None and corpus.bucket(i, 10):
            counts.update(corpus.words(corpus.lower(t or "")))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    expected = {}
    for i, t in _texts(rows):
        own = corpus.words(corpus.lower(t or ""))
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[w] for w in own), ends])
        expected[i] = (len(own) + 1, sum(counts[w] > 0 for w in own) + 1, base)
    for r in found:
        tokens_, known, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens_, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (r.doc_id is not None and corpus.bucket(r.doc_id, 10) == 0)
        assert math.isfinite(r.score) and r.score < 0
    # whole texts, word by word
    words = lm_score.word_counts(docs.selectExpr("text", "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0, false) AS trains"))
    lattice, end_score = lm_score.fitted(words, ends, "piece_bpe_32k.model", 3)
    by_id = {r.doc_id: r.score for r in found}
    for i, t in _texts(rows):
        own = [lattice.word(w.encode()) for w in corpus.words(corpus.lower(t or ""))]
        assert by_id[i] == pytest.approx(math.fsum(own) + end_score, rel=1e-6)
    assert sorted(map(str, lm_score.score_texts(docs, table_size=50).collect())) == sorted(map(str, found))
    plain = lm_score.score_texts(docs, table_size=50, refined=0).collect()
    assert sum(r.score for r in found) > sum(r.score for r in plain)
    extra = docs.selectExpr("*", "1 AS id", "2 AS word", "3 AS trains", "4 AS score")
    other = {r.doc_id: r.score for r in lm_score.score_texts(extra, table_size=100_000, refined=0).collect()}
    assert all(r.score == pytest.approx(other[r.doc_id], rel=1e-9) for r in plain)
    assert lm_score.score_texts(corpus.frame(spark, [])).count() == 0


def test_long_words_take_little_memory_and_may_be_frequent(spark):
    import tracemalloc

    lattice = lm_score.Lattice({"▁": -2.0, "a": -3.0, "ab": -4.0}, [-6.0] * 256)
    tracemalloc.start()
    score = lattice.word(b"ab" * 200_000)
    assert tracemalloc.get_traced_memory()[1] < 8_000_000 and score < -300_000
    tracemalloc.stop()
    line = "=" * 300
    rows = [(k, f"{line} word{k % 7} {line}x", "", "", 0) for k in range(60)] + [(90, "y" * 20_000, "", "", 0)]
    few, many = (sorted(map(str, lm_score.score_texts(corpus.frame(spark, rows), table_size=n).collect())) for n in (1, 1000))
    pattern = r"score=(-[0-9.]+)"
    import re

    for a, b in zip(few, many):
        assert [float(x) for x in re.findall(pattern, a)] == pytest.approx([float(x) for x in re.findall(pattern, b)], rel=1e-9)


def test_lattice_sums_all_segmentations():
    p = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.15, "ab": 0.05, "▁ab": 0.1}
    lattice = lm_score.Lattice({k: math.log(v) for k, v in p.items()}, [math.log(1e-4)] * 256)

    def total(text):
        if not text:
            return 1.0
        out = p.get(text[0], 0) * total(text[1:]) + 1e-4 ** len(text[0].encode()) * total(text[1:])
        return out + sum(p.get(text[:k], 0) * total(text[k:]) for k in range(2, len(text) + 1))

    def pieces(text):
        """(probability, pieces) of every segmentation."""
        if not text:
            yield 1.0, []
            return
        for q, rest in pieces(text[1:]):
            yield 1e-4 ** len(text[0].encode()) * q, rest
        for k in range(1, len(text) + 1):
            if text[:k] in p:
                for q, rest in pieces(text[k:]):
                    yield p[text[:k]] * q, [text[:k], *rest]

    for word in ("a", "ab", "aab", "abba", "é", "bb"):
        assert lattice.word(word.encode()) == pytest.approx(math.log10(total("▁" + word)), rel=1e-9)
        expected: Counter = Counter()
        for q, own in pieces("▁" + word):
            for piece in own:
                expected[piece] += 3 * q / total("▁" + word)
        found: dict = {}
        lattice.expect(word.encode(), 3, found)
        assert {k: v for k, v in found.items() if v > 1e-12} == pytest.approx({k: v for k, v in expected.items() if v > 1e-12})


def test_lm_scores_are_fitted_over_all_words(spark):
    model = "piece_bpe_32k.model"
    rng = corpus.random.Random(6)
    counted = {"".join(rng.choices("abcdefgh'é日", k=rng.randint(1, 12))): rng.randint(1, 9) for _ in range(20_300)}
    counted |= {"x" * 70: 1, "zürich" * 15: 2, "rareword": 1, "😀": 4}
    rows = [(w.encode(), n, n) for w, n in counted.items()] + [(b"heldout", 0, 3)]
    words = spark.createDataFrame(rows, "word binary, trained long, used long")
    lattice, _ = lm_score.piece_scores(lm_score.piece_counts(words, model), model)
    found = lm_score.expected_counts(words, lattice)
    pieces: dict = {}
    by_byte = np.zeros(256)
    for w, n in counted.items():
        lattice.expect(w.encode(), n, pieces, by_byte)
    expected = pieces | {f"<0x{b:02X}>": x for b, x in enumerate(by_byte)}
    assert {k: v for k, v in found.items() if v > 1e-9} == pytest.approx({k: v for k, v in expected.items() if v > 1e-9}, rel=1e-6)
    size = sum(v * (1 if k.startswith("<0x") else len(k.encode())) for k, v in found.items())
    assert size == pytest.approx(sum(n * len(("▁" + w).encode()) for w, n in counted.items()))


def test_slices_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    from paceforge.llm.common import slices

    texts = ["a" * n for n in (5, 5, 50, 1, 1, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "text": texts})
    parts = [p.column(0).to_pylist() for p in slices([batch.slice(0, 0), batch, batch.slice(3)], rows=4, most=10)]
    assert parts == [[0, 1], [2], [3, 4, 5, 6], [7, 8], [3, 4, 5, 6], [7, 8]]
