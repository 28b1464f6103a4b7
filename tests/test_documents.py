"""VARIANT documents whose keys come and go."""

from wardlight.operators import logs
from wardlight.session import scratch_path
from wardlight.sources import tabular

DOCUMENTS = [
    '{"prompt_id": 1, "prompt": "a", "detection_results": {"is_adversarial": true, "scores": [0.5, 1], "threshold": 0.1}, "new": {"x": [1]}}',
    '{"prompt_id": 2, "user_message": "b", "is_adversarial": false, "scores": [], "timestamp": "2024-01-01T00:00:01.000Z"}',
    '{"prompt_id": "3", "prompt": null, "detection_results": "none", "latency_seconds": "fast"}',
    '{}',
]


def test_documents_of_all_shapes(spark):
    path = scratch_path(spark, "documents")
    spark.createDataFrame([(d,) for d in DOCUMENTS], "value string").write.text(path)
    docs = tabular.read_documents(spark, path)
    rows = sorted(logs.flatten_documents(docs).collect(), key=repr)
    got = {(r.prompt_id, r.prompt, r.is_adversarial, r.score_index, r.score, r.threshold, r.latency_seconds) for r in rows}
    assert got == {
        (1, "a", True, 0, 0.5, 0.1, None), (1, "a", True, 1, 1.0, 0.1, None), (2, "b", False, None, None, None, None),
        (3, None, None, None, None, None, None), (None, None, None, None, None, None, None)}
    schema = tabular.document_schema(docs).first()["schema"]
    assert "user_message: STRING" in schema and "new: OBJECT<x: ARRAY<BIGINT>>" in schema
