"""Postings are counted where the texts lie; those of a repeated key are added up where they are read."""

import random
from collections import Counter

from pagewright.operators import search
from pyspark.sql import functions as F


def test_texts_are_counted_without_an_exchange(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Salt", "pepper", "the", "of", "x1", "中文字", "é"]) for _ in range(rng.randrange(0, 30))) for _ in range(80)] + [None, "", "the of"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = search.text_postings(rows, "id", F.col("text"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    tokens = {r.id: r.t for r in rows.select("id", search.keyword_tokens(F.col("text")).alias("t")).collect()}
    want = {(i, w, n, len(t)) for i, t in tokens.items() for w, n in Counter(t).items()}
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in search.postings(rows, "id", F.col("text")).select("id", "term", "tf", "dl").collect()} == want


def test_repeated_keys_add_up(spark, tmp_path):
    rows = spark.createDataFrame([("a", "salt salt rice"), ("a", "salt corn rye"), ("b", "salt")], "id string, text string")
    search.write_postings(rows, "id", F.col("text"), str(tmp_path))
    read = search.read_postings(spark, str(tmp_path), ["salt", "rye"])
    assert sorted((r.id, r.term, r.tf, r.dl) for r in read.collect()) == [("a", "rye", 1, 3), ("a", "salt", 3, 3), ("b", "salt", 1, 1)]
