from collections import Counter

import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.test_classifiers import plain_scores
from tests.llm.test_mixing import check_plan
from tidemill.llm import pii


def test_stages_on_small_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids, now = {r.doc_id for r in docs.collect()}, docs
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES[:-1]:
        before = now.collect()
        now = spark.createDataFrame(stage(spark, now, small).collect(), docs.schema)
        after = {r.doc_id: r for r in now.collect()}
        assert now.columns == docs.columns and set(after) <= {r.doc_id for r in before}
        if name == "quality":
            scores = plain_scores(before, spark.read.parquet(f"{small}/labels.parquet").collect())
            assert set(after) == {i for i, s in scores.items() if s >= 0.3}
        elif name == "near_duplicates":
            groups = brute.classes([(r.doc_id, r.text) for r in before])
            assert set(after) == set(groups.values())
        elif name == "decontamination":
            assert {r.doc_id for r in before} - set(after) == {d for d, _ in brute.leaks([(r.doc_id, r.text) for r in before], items)}
        elif name == "personal_data":
            assert set(after) == {r.doc_id for r in before}
            for r in before:
                assert after[r.doc_id].text == pii.redact(r.text, pii.spans(r.text)) and after[r.doc_id].n_chars == len(after[r.doc_id].text)
    assert len(ids) > len(after) > 0.5 * len(ids)
    mixed = pipeline.STAGES[-1][1](spark, now, small).collect()
    plan = check_plan(now)  # the plain version of what each source's last turn takes
    want = {r.id: r.whole * r.rows + r.part for r in plan.pieces.collect()}
    assert {i: n for i, n in want.items() if n} == Counter(r.doc_id for r in mixed)
    assert all(after[r.doc_id].text == r.text for r in mixed)


def test_run(spark, small, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(pipeline, "shared_dir", lambda spark: str(tmp_path))
    out = pipeline.run(spark, small)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 0
    (stages,) = os.listdir(tmp_path)
    assert os.listdir(f"{tmp_path}/{stages}") == ["mixing"]  # earlier stages are gone


def test_release(spark):
    import os

    from tidemill.llm import common

    df = common.cut(spark.range(5))
    path = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert df.count() == 5 and os.path.exists(path)
    common.release(spark)
    assert not os.path.exists(path)
    assert common.cut(spark.range(5)).count() == 5


def test_odd_rows(spark, small):
    """Nulls everywhere, empty texts, repeated rows and clashing columns pass all stages; so does an empty table."""
    rows = [(None,) * 5, (None,) * 5, (1, "", "en", "a", 0), (2, None, None, None, None), (3, "fine words in a row, here they are.", "en", "a", 35), (3, "fine words in a row, here they are.", "en", "a", 35)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, text_key string, mix_shard int")
    for table in (df, df.limit(0)):
        for _, stage in pipeline.STAGES[1:]:
            out = stage(spark, table, small)
            assert out.columns[: len(df.columns)] == df.columns
            assert out.count() <= 2 * table.count()
        assert pipeline.STAGES[0][1](spark, table, small).columns == df.columns
        pipeline.STAGES[0][1](spark, table, small).count()
