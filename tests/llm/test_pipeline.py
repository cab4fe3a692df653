"""The pipeline on a small table: every stage does its work, and brute force agrees where it can."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = [f"The {w} walked along the river and told the {v} about a long day in town number {i}." for i, (w, v) in enumerate([("farmer", "miller"), ("teacher", "baker"), ("sailor", "judge"), ("doctor", "painter")] * 30)]
    base = " ".join(f"plain{k} words" for k in range(150))
    rows = [(i, t) for i, t in enumerate(good)] + [(500 + i, "&&& ### %%% " * 20 + str(i)) for i in range(60)]
    rows += [(700, base + " first"), (701, base + " second"), (702, "This clean note holds the secret benchmark passage of nine words, here."), (703, None)]
    rows += [(710 + k, f"Only this is my own sentence number {k} here.\nSubscribe to our newsletter for more news today") for k in range(5)]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(t or "") for _, t in rows], pa.int64())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows if i < 560], pa.int64()), "quality": pa.array([int(i < 500) for i, _ in rows if i < 560], pa.int32()), "toxic": pa.array([0 for i, _ in rows if i < 560], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": ["the secret benchmark passage of nine words"]}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    kept = stages["quality classifier"](spark, docs, str(tmp_path))
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & set(range(500, 560)) and len(ids & set(range(120))) >= 118
    lined = stages["line dedup"](spark, docs, str(tmp_path))
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lined.collect()}
    assert [text[710 + k][0].count("newsletter") for k in range(5)] == [0, 0, 0, 0, 1]
    assert all(n == len(t or "") for t, n in text.values() if t is not None)
    near = {r["doc_id"] for r in stages["SimHash near-dedup"](spark, docs, str(tmp_path)).collect()}
    assert 700 in near and 701 not in near and {702, 710, 711} <= near
    clean = {r["doc_id"] for r in stages["benchmark decontamination"](spark, docs, str(tmp_path)).collect()}
    assert clean == {i for i, _ in rows} - {702}
    for name in list(stages)[:4]:
        assert stages[name](spark, docs, str(tmp_path)).columns == columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= ids - {701, 702}
