"""Quality rules, language, language model and secrets against plain models."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from flightline.llm import language, lbl, lm, quality, queries, secrets
from flightline.llm.forest import evaluate
from flightline.llm.text import id_remainder

LABELS = "doc_id long, quality int, toxic int"


def check_quality(docs, labels):
    rows = docs.collect()
    order = [r.doc_id for r in quality.trusted_ids(labels).collect()]
    trusted = {k for k, r in enumerate(rows) if r.doc_id in set(order) and r.doc_id is not None}
    scores = brute.quality_scores([r.text for r in rows], trusted, quality.BUCKETS, quality.SMOOTHING)
    want = []
    for row, score in zip(rows, scores, strict=True):
        base = brute.base_rules(row.text)
        kept = not base["base_failed"] and score is not None and score >= quality.THRESHOLD
        want.append((row.doc_id, *base.values(), score, kept))
    found = [
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.score, r.kept)
        for r in quality.judge_quality(docs, labels).collect()
    ]
    rounded = lambda t: (-1 if t[0] is None else t[0], *t[1:7], None if t[7] is None else round(t[7], 9), t[8])
    assert sorted(map(rounded, found), key=repr) == sorted(map(rounded, want), key=repr)


def test_quality_equals_brute_force(spark, sf_dir, documents):
    check_quality(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, None), (2, None, 1), (None, 1, 0), (4, 1, 1)], LABELS)
    check_quality(odd, labels)
    check_quality(odd, labels.limit(0))
    assert quality.judge_quality(nothing, labels).collect() == []


def test_language_on_held_out_rows(spark, sf_dir, documents):
    labelled = {r.doc_id: r.lang for r in documents.collect()}
    found = queries.op9_language(spark, sf_dir).collect()
    assert len(found) == len(labelled)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == labelled[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_rows(odd, nothing):
    learned = [("en", b"the quick brown fox jumps over the lazy dog and then some more words "), ("de", b"der schnelle braune fuchs springt ")]
    found = language.identify(odd, learned).collect()
    assert [r.doc_id for r in found] == [r.doc_id for r in odd.collect()]
    for r in found:
        blank = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == blank and (not blank or (r.score == 0 and r.rejected))
    assert {r.lang_pred for r in language.identify(odd, []).collect()} == {"und"}
    assert language.identify(nothing, learned).collect() == []
    assert language.train(odd.filter("lang is null")) == []
    model = language.Classifier(learned)
    assert [model.classify(t, 0.002)[0] for t in ("² Ⅷ 12_", "x²", "")] == ["und", "en", "und"]


def test_language_model_base_and_gain(spark, sf_dir, documents):
    rows = documents.select("doc_id", "text", id_remainder(F.col("doc_id"), 5).alias("k")).collect()
    n, _, want = brute.unigram_scores([r.text for r in rows], [r.k != 1 for r in rows])
    found = {r.doc_id: r for r in queries.op4_lm(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for row, (tokens, known, base) in zip(rows, want, strict=True):
        got = found[row.doc_id]
        assert (got.n_tokens, got.n_known, got.train_tokens, got.held_out) == (tokens, known, n, row.k == 1)
        assert got.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_normalised():
    shares = np.random.default_rng(0).random(40)
    shares /= shares.sum()
    model = lbl.Model.start(shares, seed=3)
    draw = np.random.default_rng(1)
    trainer = lbl.Trainer(model, shares, 1)
    trainer.learn(*(draw.integers(0, 40, 5_000) for _ in range(3)))
    scorer, every = lbl.Scorer(model), np.arange(40)
    for last, before in ((0, 0), (3, 17), (39, 2)):
        total = (10 ** scorer.log10(np.full(40, last), np.full(40, before), every)).sum()
        assert total == pytest.approx(1.0, abs=1e-4)


def test_language_model_capacity():
    """Narrower vectors and fewer noise classes cost held-out score on every input."""
    assert (lbl.WIDTH, lbl.NOISE, lbl.RATE) == (24, 32, 0.15)
    assert lbl.Model.start(np.full(4, 0.25)).inputs.shape == (4, 24)


def test_language_model_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = lm.score_documents(odd, F.col("doc_id") != 5).collect()
    training = [i not in (5, None) for i, _ in rows]
    n, _, want = brute.unigram_scores([t for _, t in rows], training)
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(key((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6))) for r in found) == sorted(
        key((i, a, b, round(c, 6))) for (i, _), (a, b, c) in zip(rows, want, strict=True)
    )
    assert {r.train_tokens for r in found} == {n}
    assert lm.score_documents(nothing, F.lit(True)).collect() == []
    none = lm.score_documents(odd, F.lit(False)).collect()
    assert {(r.base_score, r.score, r.n_known) for r in none} == {(0.0, None, 0)}


def test_language_model_with_rare_ends(spark, monkeypatch):
    """Training texts so long that the end token has less than the share of a frequent word."""
    monkeypatch.setattr(lm, "FREQUENT", 3)
    rows = [(1, "a a a a a b b b b c"), (2, "a b c d"), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score_documents(table, F.col("doc_id") == 1).collect()}
    _, _, want = brute.unigram_scores([t for _, t in rows], [True, False, False])
    for (i, _), (tokens, known, base) in zip(rows, want, strict=True):
        assert (found[i].n_tokens, found[i].n_known) == (tokens, known)
        assert found[i].base_score == pytest.approx(base, rel=1e-9)


def brute_candidates(text):
    return [(m.start(), m[0]) for m in re.finditer(r"[A-Za-z0-9_+/=.~-]{16,}", (text or "").replace("\x01", " ").replace("\x02", " "))]


def test_secret_candidates_and_planted_tokens(documents):
    found = {r.doc_id: r for r in secrets.scan(documents).collect()}
    for row in documents.collect():
        got = found[row.doc_id]
        assert [(f.start, f.secret) for f in got.findings] == brute_candidates(row.text)
        planted = re.findall(r'token = "([0-9a-f]{40})"', row.text)
        assert set(planted) <= {f.secret for f in got.findings if f.is_secret}
        clean = row.text
        for f in sorted(got.findings, key=lambda f: -f.start):
            if f.is_secret:
                clean = clean[: f.start] + secrets.REDACTED + clean[f.start + len(f.secret) :]
        assert got.redacted == clean


def test_forest_column_equals_the_trees_and_generalises(spark):
    forest = secrets.trained_forest(spark)
    fresh = secrets.findings_frame(spark, secrets.labelled_findings(400, 99))
    rows = fresh.withColumn("p", secrets.forest_column(forest, F.col("features"))).collect()
    right = 0
    for r in rows:
        want = float(np.mean([evaluate(tree, r.features) for tree in forest]))
        assert r.p == pytest.approx(want)
        right += (want > secrets.THRESHOLD) == r.label
    assert right >= 0.95 * len(rows)


def test_secrets_odd_rows(spark, odd, nothing):
    found = secrets.scan(odd, keep=("doc_id", "score")).collect()
    assert [r.doc_id for r in found] == [r.doc_id for r in odd.collect()]
    assert all(r.redacted == s.text and r.score == "clash" for r, s in zip(found, odd.collect(), strict=True))
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    table = spark.createDataFrame([(1, f'\x01 token = "{key}" x\x02 token = "{key}"', None)], "doc_id long, text string, source string")
    (row,) = secrets.scan(table).collect()
    assert [f.secret for f in row.findings] == [key, key]
    assert row.redacted == f'  token = "{secrets.REDACTED}" x  token = "{secrets.REDACTED}"'
    assert secrets.findings(nothing).collect() == []


def test_language_sample_is_bounded_for_repeated_ids(spark):
    rows = [(1, f"text number {i} of one id", "en") for i in range(1_000)] + [(2, "ein Text", "de")] * 1_000
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = language.sample_per_language(table, doc_id="doc_id", text="text", lang="lang").collect()
    assert sorted(r.lang for r in sample) == ["de"] + ["en"] * language.SAMPLE_DOCS


def test_language_slices_cover_a_text_and_share_the_dictionary(spark):
    text = "".join(chr(0x4E00 + i) for i in range(9_000))
    table = spark.createDataFrame([(1, text, "zh"), (2, "kurz", "de")], "doc_id long, text string, lang string")
    slices = {r.lang: r.slices for r in language.sample_per_language(table, doc_id="doc_id", text="text", lang="lang").collect()}
    assert slices["de"] == ["kurz"]
    assert slices["zh"][0] == text[:500] and slices["zh"][-1] == text[-500:] and len(slices["zh"]) == language.SLICES
    assert language.even_share([5, 100, 100], 105) == 50 and language.even_share([5, 6], 100) == 6
    assert language.even_share([], 10) == 0
