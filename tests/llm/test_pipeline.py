"""Each stage of the pipeline on its own input, and the whole."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and gave."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns_and_rows(spark, stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == pipeline.COLUMNS
    sizes = [after.count() for _, _, after in stages]
    assert 0 < sizes[0] < 200 and sizes[1] == sizes[0] and sizes[2] < sizes[1] and sizes[4] >= sizes[3]


def test_quality_keeps_clean_documents(spark, stages):
    good = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in stages[0][2].select("doc_id").collect()}
    marks = {r["doc_id"]: r["quality"] for r in good.collect()}
    assert all(d in kept for d, q in marks.items() if q == 1) and sum(d in kept for d, q in marks.items() if q == 0) <= 0.2 * sum(q == 0 for q in marks.values())


def test_no_near_duplicates_are_left(stages):
    from inkwright.llm import jaccard

    found = jaccard.near_duplicates(stages[2][2]).collect()
    assert all(r["n_links"] == 0 and r["class_id"] == r["doc_id"] for r in found)
    classes = {r["class_id"] for r in jaccard.near_duplicates(stages[2][1]).collect()}
    assert classes == {r["doc_id"] for r in found}


def test_mix_and_bins(stages):
    from inkwright.llm import mixing

    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(stages[3][1]).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in stages[3][2].collect()) == want
    words = Counter()
    for r in stages[4][2].collect():
        words[r["doc_id"]] += r["size"]
    assert words == Counter({r["doc_id"]: r["taken"] for r in mixing.mix(stages[3][1]).collect() if r["copies"]})


def test_run_is_its_stages(spark, stages):
    whole = sorted(map(tuple, pipeline.run(spark, SF).collect()))
    assert whole == sorted(map(tuple, stages[-1][2].collect())) and pipeline.ORACLE_SQL is None


def test_odd_rows_pass_all_stages(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(60))
    rows = [(1, None, None, None, None), (2, "", "x", "a", 0), (None, text, None, "a", 3), (3, text, None, None, 3), (3, text, None, None, 3), (3, "other text", "e", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs_in in (docs, docs.limit(0)):
        now = docs_in
        for _, stage in pipeline.STAGES:
            now = stage(spark, now, SF)
        now.collect()
