"""Pipeline stages without writes in between, side by side, and a sample that many labels do not enlarge."""

import corpus_pipeline
import pytest
from pagewright.llm import langid
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.select("doc_id", "piece", "start", "length").collect()))


@pytest.fixture(scope="module")
def wanted(spark):
    return _rows(corpus_pipeline.run(spark, SF))


def test_stages_chain_without_writes(spark, wanted):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert _rows(docs) == wanted


def test_two_pipelines_in_turns(spark, wanted, tmp_path):
    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    assert _rows(first) == _rows(second) == wanted


def test_many_labels_do_not_enlarge_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "LABELS", 50)
    monkeypatch.setattr(langid, "ALL_CHARS", 5000)
    noise = spark.range(20_000).select(F.concat(F.lit("l"), "id").alias("lang"), F.concat(F.lit("words of row "), "id").alias("text"))
    often = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"), F.concat(F.lit("many words "), "id").alias("text"))
    sample = langid.training_sample(noise.unionByName(often), F.col("lang"), F.col("text"))
    labels = {k for k, _ in sample}
    assert len(labels) == 50 and {"aa", "bb"} <= labels
    assert sum(len(t) for _, t in sample) < 2 * 5000


def test_the_language_stage_decides_by_its_prediction(spark):
    """Each of five languages has letters of its own; a text of all five in equal parts is in none of them."""
    made = {"aa": "adbe cafe bead face abed ", "kk": "kilo honk jilk mink olim ", "tt": "trust vuts wurst stux rust ", "zz": "zgyz gyzy zyg gzzy ygzy zg ", "00": "é ñóé óñé éñ óé "}
    rows = [(i, made[k] * 6, k) for i, k in enumerate(sorted(made) * 40)]
    odd = [(1000, "".join(made.values()) * 6, None), (1001, None, "aa"), (1002, "12 34", "kk")]
    docs = spark.createDataFrame(rows + odd * 2, "doc_id long, text string, lang string")
    kept = [r.doc_id for r in corpus_pipeline.identified(spark, docs, "unused").select("doc_id").collect()]
    assert sorted(kept) == [i for i, _, _ in rows]
    scores = {r.doc_id: r.score for r in langid.identify(docs).collect()}
    assert scores[1000] < langid.SURE <= min(scores[i] for i, _, _ in rows)
