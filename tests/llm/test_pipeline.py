"""The pipeline stage by stage, each against a plain model on its own input."""

import corpus_pipeline
import brute
from flightline.llm import language, quality, secrets
from test_judging import brute_candidates
from test_tokens import check_packed


def test_every_stage_on_what_the_one_before_kept(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "language ID", "MinHash near-dedup", "secret scans", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.collect()

    good = {r.doc_id for r in quality.trusted_ids(labels).collect()}
    scores = brute.quality_scores(
        [r.text for r in rows], {k for k, r in enumerate(rows) if r.doc_id in good}, quality.BUCKETS, quality.SMOOTHING
    )
    kept = stages["quality rules"](spark, docs, sf_dir).cache()
    want = [
        r for r, s in zip(rows, scores, strict=True)
        if not brute.base_rules(r.text)["base_failed"] and s >= quality.THRESHOLD
    ]
    assert sorted(kept.collect()) == sorted(want)

    model = language.Classifier(language.train(kept))
    told = stages["language ID"](spark, kept, sf_dir).cache()
    judged = [(r, *model.classify(r.text, language.MIN_MARGIN)) for r in want]
    want = [r.asDict() | {"lang": lang} for r, lang, _, rejected in judged if not rejected]
    assert sorted(map(tuple, told.collect())) == sorted(tuple(r.values()) for r in want)

    once = stages["MinHash near-dedup"](spark, told, sf_dir).cache()
    groups, _ = brute.components([(r["doc_id"], r["text"]) for r in want])
    want = [r for r in want if groups[r["doc_id"]] == r["doc_id"]]
    assert sorted(map(tuple, once.collect())) == sorted(tuple(r.values()) for r in want)

    clean = stages["secret scans"](spark, once, sf_dir).cache()
    assert clean.columns == docs.columns and clean.schema == docs.schema
    found = {r.doc_id: r for r in clean.collect()}
    assert set(found) == {r["doc_id"] for r in want}
    for r in want:
        secret = [c for _, c in brute_candidates(r["text"]) if c not in found[r["doc_id"]].text]
        text = r["text"]
        for c in secret:
            text = text.replace(c, secrets.REDACTED)
        assert found[r["doc_id"]].text == text and found[r["doc_id"]].n_chars == len(text)

    check_packed(
        stages["packing"](spark, clean, sf_dir).collect(), [(r.doc_id, r.text) for r in found.values()]
    )


def test_stages_with_odd_and_no_rows(spark, odd, nothing, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, sf_dir)
        assert stage(spark, nothing, sf_dir).collect() == [], name
        if name != "packing":
            assert made.columns == list(corpus_pipeline.COLUMNS), name
        made.collect()
