"""Normalised tables on journals written by hand."""

from flightline.registry import tables as reg


def test_the_first_of_a_result_id_counts_over_all_beans(spark):
    content = "source STRING, kind STRING, value_json STRING, timestamp_ns BIGINT, version STRING, result_id STRING, confidence DOUBLE"
    rows = [
        (7, "run", 2, 3, "enrichment.added", ("worker", "size", "7", 70, "v1", "r", None)),
        (4, "run", 5, 9, "enrichment.added", ("worker", "defect", "4", 40, "v1", "r", 0.5)),
        (5, "run", 2, 2, "enrichment.added", ("worker", "note", "5", 50, "v1", "other", None)),
        (1, "run", 2, 1, "bean.created", None),
    ]
    fields = content.replace(" STRING", ": STRING").replace(" BIGINT", ": BIGINT").replace(" DOUBLE", ": DOUBLE")
    journal = spark.createDataFrame(
        rows, f"stream_sequence BIGINT, run_id STRING, sequence BIGINT, revision BIGINT, kind STRING, enrichment STRUCT<{fields}>"
    )
    found = {r.result_id: (r.sequence, r.registry_revision, r.kind, r.value_json) for r in reg.first_enrichments(journal).collect()}
    assert found == {"r": (5, 9, "defect", "4"), "other": (2, 2, "note", "5")}
    assert reg.enrichments(journal).count() == 3
