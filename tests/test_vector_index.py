import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import search, vector_index

SF = "/root/testdata/sf0.001"


def _asked(v):
    return v.filter("vec_id % 20 = 0").select(F.concat(F.lit("q"), F.col("vec_id")).alias("query_id"), F.col("vector").alias("query_vector"))


def _by_query(rows):
    found = {}
    for r in rows:
        found.setdefault(r[0], {})[r[3]] = (r[1], r[2])
    return found


def test_index(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.concat(F.lit("chunk:"), F.col("vec_id")).alias("id"), F.col("embedding").alias("vector"))
    named = v.select("id", "vector").unionByName(spark.createDataFrame([(None, [1.0] * 64), ("none", None)], "id string, vector array<float>"))
    path = str(tmp_path)
    vector_index.build(named, "id", path)
    exact = _by_query(search.vector_topk_multi(named, _asked(v), "id", 10).collect())
    every = _by_query(vector_index.search(spark, path, "id", _asked(v), 10, vector_index.MAX_CELLS, block=7).collect())
    assert every == exact and len(exact) == 25 and all(len(x) == 10 for x in exact.values())
    some = _by_query(vector_index.search(spark, path, "id", _asked(v), 10).collect())
    hits = [len({k for k, _ in some[q].values()} & {k for k, _ in exact[q].values()}) for q in exact]
    assert sum(hits) >= 0.9 * 250
    one = vector_index.search(spark, path, "id", _asked(v).limit(1), 10, 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "cell#" in filters and "IN" not in filters  # one cell's folder alone


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id string, vector array<float>")
    vector_index.build(none, "id", str(tmp_path))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert vector_index.search(spark, str(tmp_path), "id", asked, 3).count() == 0
    assert search.vector_topk_multi(none, asked.filter("false"), "id", 3).columns == ["query_id", "id", "score", "rank"]


def test_ties_of_the_last_place_go_by_key(spark):
    v = spark.createDataFrame([(f"k{i:04d}", [1.0, 0.0]) for i in range(5000)], "id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, query_vector array<double>")
    assert [r.id for r in search.vector_topk_multi(v, asked, "id", 4).orderBy("rank").collect()] == ["k0000", "k0001", "k0002", "k0003"]


def test_fusion_sorts_by_unrounded_sums(spark):
    def places(ranks):
        rows = [(f"{name}{i}", i) for name, own in ranks for i in own]
        return spark.createDataFrame(rows, "doc_id string, rank int")

    first = places([("x", [i for i in range(1, 30) if i not in (2, 28)])]).unionByName(spark.createDataFrame([("early", 2), ("late", 28)], "doc_id string, rank int"))
    second = places([("y", [i for i in range(2, 30) if i != 26])]).unionByName(spark.createDataFrame([("early", 26), ("late", 1)], "doc_id string, rank int"))
    got = search.rrf_fuse([first, second], "doc_id", limit=2).orderBy("rank").collect()
    want = sorted([("early", 1 / 62 + 1 / 86), ("late", 1 / 88 + 1 / 61)], key=lambda r: -r[1])
    assert [r.doc_id for r in got] == [w[0] for w in want] == ["late", "early"]
    assert len({r.score for r in got}) == 1 and np.isclose(got[0].score, want[0][1], atol=1e-6)
