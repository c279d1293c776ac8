"""Every text operator on tables with extra columns whose names clash with its own, on empty tables, and on a text of over a megabyte."""

from __future__ import annotations

import pytest

from paceforge.llm import language_id, license_scan, lm_score, mixing, quality_classifier, quality_rules, url_filter
from tests.llm import corpus

CLASHES = (
    "'x' AS id", "'x' AS score", "'x' AS kept", "'x' AS n_tokens", "'x' AS n_words", "'x' AS block", "'x' AS epoch", "'x' AS tokens", "'x' AS word",
    "'x' AS lang_pred", "'x' AS predicted", "'x' AS held_out", "'x' AS labels", "'x' AS key", "'x' AS bin", "'x' AS n", "'x' AS h",
)


def _judge(name, docs, labels):
    if name == "op1":
        return mixing.mix_sources(docs, block_tokens=500)
    if name == "op3":
        return quality_rules.quality_rules(docs)
    if name == "op4":
        return lm_score.score_texts(docs)
    if name == "op6":
        return quality_classifier.score_quality(docs, quality_classifier.train(docs, labels))
    if name == "op9":
        return language_id.identify(docs, language_id.train(docs, per_language=20, pieces=1))
    return license_scan.license_scan(docs).drop("detections")


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op6", "op9", "op11"])
def test_clashing_names_and_empty_tables(spark, name):
    rows = [r for r in corpus.documents(n=60) if r[0] is not None]
    rows.append((8000, "long words and " * 100_000 + "the end", "en", "s1", 0))
    docs, labels = corpus.frame(spark, rows), corpus.labels(spark, rows)
    plain = sorted(map(str, _judge(name, docs, labels).collect()))
    assert plain == sorted(map(str, _judge(name, docs.selectExpr("*", *CLASHES), labels).collect()))
    assert len(plain) >= len(rows) if name != "op1" else plain
    assert _judge(name, docs.limit(0), labels.limit(0)).count() == 0


def test_url_filter_with_clashing_names(spark):
    rows = [(k, f"https://a{k % 7}.{('org', 'com', 'net')[k % 3]}/{('en', 'de', 'x')[k % 3]}/{k}?q={k}") for k in range(90)] + [(90, None), (91, "no host")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    extra = df.selectExpr("*", *CLASHES, "'x' AS host", "'x' AS path", "'x' AS rule", "'x' AS ruled", "'x' AS suffix", "'x' AS verdict", "'x' AS fold")
    assert sorted(map(str, url_filter.filter_urls(df).collect())) == sorted(map(str, url_filter.filter_urls(extra).collect()))
