"""Rows that the recursion of op5, op12 and the pipeline's near_dedup joins with pivots, on groups of two sizes."""

import random

from pagewright.llm import chosen_path
from pyspark.sql import functions as F


def test_a_large_group_is_joined_once_a_run(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET", 40)
    joined, kind = [], type(spark.range(1))
    met = kind.join

    def count(self, other, on=None, how=None):
        out = met(self, other, on, how)
        if isinstance(on, str) and on == "path" and how is None and "pivot_sketch" in other.columns:
            joined.append(out)
        return out

    monkeypatch.setattr(kind, "join", count)
    sums = {}
    for size in (150, 300):
        rng = random.Random(2)
        base = [rng.choice("abcdefgh") + str(rng.randrange(10_000)) for _ in range(200)]
        texts = [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in (rng.randrange(200) for _ in range(size))]
        docs = spark.createDataFrame([(i, t + f" x{i}") for i, t in enumerate(texts)], "doc_id long, text string")
        joined.clear()
        found = chosen_path.near_duplicates(docs)
        assert found.select("class_id").distinct().count() == 1 and found.agg(F.min("n_links")).first()[0] == size - 1
        assert len(joined) == 1  # edges and split from one join; before, the split had its own
        sums[size] = sum(d.count() for d in joined)
    runs = chosen_path.runs_for(chosen_path.RECALL, chosen_path.THRESHOLD)
    assert 0 < sums[300] <= runs * 300
    assert sums[300] <= 2.4 * sums[150]  # in proportion to the group, not to its square
