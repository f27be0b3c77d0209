import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import providers
from pagewright.plans.engine import build_engine
from pagewright.plans.settings import Settings
from pagewright.sources import files


def _loader(folder):
    """Each load leaves a file; the yes of a pair grows with the number in its document."""

    def load():
        import tempfile

        os.close(tempfile.mkstemp(prefix=f"{os.getpid()}-", dir=folder)[0])

        def score(prompts, max_length):
            assert len(prompts) <= providers.RERANK_BATCH and max_length == 77
            return [[0.0, (int(p.split("number ")[1].split(" ")[0]) * 7 % 11) / 3 + len(p.split("<Query>: ")[1].split("\\n")[0]) / 50] for p in prompts]

        return score

    return load


def test_many_queries_in_one_plan(spark, tmp_path):
    model = providers.CrossEncoder(load=_loader(str(tmp_path)), max_length=77)
    rows = [(f"q{q}", f"what {q}", r, f"c{r}", f"number {q * r} " + "x" * (r * 37 % 90)) for q in range(100) for r in range(1, 8)]
    hits = spark.createDataFrame(rows, "query_id string, query string, rank int, chunk_id string, text string")
    got = {}
    for r in model.rerank_many(hits, 3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, round(r.score, 9), r.source)
    assert len(got) == 100 and all(set(g) == {1, 2, 3} for g in got.values())
    for q in ("q3", "q41", "q99"):
        one = model.rerank(hits.filter(F.col("query_id") == q), "what " + q[1:], 3).collect()
        assert got[q] == {r["rank"]: (r.chunk_id, round(r.score, 9), r.source) for r in one}
    workers = [name.split("-")[0] for name in os.listdir(tmp_path)]
    assert workers and len(workers) == len(set(workers))  # at most one load a worker, over all tasks and plans


def test_constructor_and_dimensions():
    with pytest.raises(ValueError, match="score and load"):
        providers.CrossEncoder()
    assert providers.LocalEmbedding(lambda: lambda texts: np.ones((len(texts), 5))).dimensions == 5
    assert providers.LocalEmbedding(lambda: None, 3).dimensions == 3


def test_engine_from_settings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/locks.md").write_text("# Locks\n\n## AQS\n\nThe queue keeps waiting threads in order.")
    (tmp_path / "in/tea.txt").write_text("Green tea is steeped for two minutes.")
    engine = build_engine(spark, Settings(index_path=str(tmp_path / "index"), reranker_enabled=False))
    engine.ingest(str(tmp_path / "in"))
    found = engine.search("waiting threads", 2).orderBy("rank").collect()
    assert found[0].text.startswith("The queue") and found[0].section == "AQS"
    assert "The queue keeps waiting threads" in engine.answer("waiting threads", 2)
    assert engine.documents().count() == 2
    assert engine.delete(found[0].document_id) and not engine.delete("none")
    assert "The queue" not in engine.answer("waiting threads", 2)


def test_types_of_files(spark):
    rows = spark.createDataFrame([(".md", None), ("a..md", None), ("x", "Text/Markdown"), ("x", "text/markdown"), ("d.d/.pdf", None), ("a.", None)], "f string, m string")
    assert [r.k for r in rows.select(files.classify(F.col("f"), F.col("m")).alias("k")).collect()] == [None, "direct", None, "direct", None, None]
