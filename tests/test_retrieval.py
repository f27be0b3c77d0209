import random

from pyspark.sql import functions as F

from pagewright.operators import answers, layout, search, store
from pagewright.sources import files


def test_keyword_tokens(spark):
    row = spark.range(1).select(search.keyword_tokens(F.lit("The Redis锁机制 is 42")).alias("t")).first()
    assert row.t == ["redis", "锁机", "机制", "42"]


def test_topk_multi_matches_single(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)], "id long, vector array<double>")
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    many = search.vector_topk_multi(v, q, "id", 4, block=1).filter("query_id = 20").orderBy("rank").collect()
    one = search.vector_topk(v, v.filter("id = 20").select(F.col("vector").alias("query_vector")), "id", 4).orderBy("rank").collect()
    assert [(r.id, r.score) for r in many] == [(r.id, r.score) for r in one]


def test_plans(spark):
    v = spark.range(100).select(F.col("id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    plan = search.vector_topk(v, v.filter("id = 3").select(F.col("vector").alias("query_vector")), "id", 5)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" in plan and "TakeOrderedAndProject" in plan


def test_rerank_merge_equals_a_loop(spark):
    rng = random.Random(12)
    for _ in range(4):
        hits = [(i, f"h{i}", round(rng.random(), 3), "rrf") for i in range(1, rng.randrange(3, 9))]
        result = [(p, rng.choice([None, -1, 99, *range(len(hits))]), round(rng.random(), 3)) for p in range(rng.randrange(0, 10))]
        limit, taken, want = rng.randrange(1, 9), set(), []
        for _, i, score in result:
            if i is not None and 0 <= i < len(hits) and i not in taken:
                taken.add(i)
                want.append((hits[i][1], score))
        want += [(h[1], h[2]) for i, h in enumerate(hits) if i not in taken]
        got = answers.merge_rerank_result(spark.createDataFrame(hits, "rank int, chunk_id string, score double, source string"), spark.createDataFrame(result, "pos int, index int, relevance_score double"), limit)
        rows = got.orderBy("rank").collect()
        assert [(r.chunk_id, r.score) for r in rows] == want[:limit] and {r.source for r in rows} == {"reranked"}


def test_answers_and_events(spark):
    hits = spark.createDataFrame([(2, "c2", "t", "second", 0.1), (1, "c1", "t", "first", 0.2)], "rank int, chunk_id string, title string, text string, score double")
    assert answers.simple_answer(hits, "q").first().answer == answers.HEADER + "\n\n[1] first\n\n[2] second"
    assert answers.simple_answer(hits.filter("false"), "q").first().answer == "No local context found for: q"
    events = answers.stream_events(hits, "q").orderBy("seq").collect()
    assert [e.event for e in events] == ["citations", "delta", "delta", "done"]
    lines = spark.createDataFrame([(0, 'data: {"choices":[{"delta":{"content":"a"}}]}'), (1, 'data: {"choices":[{"delta":{}}]}'), (2, "data: [DONE]"), (3, 'data: {"choices":[{"delta":{"content":"z"}}]}')], "pos int, line string")
    assert [r.delta for r in answers.parse_model_stream(lines).collect()] == ["a"]
    frame = spark.createDataFrame([("event: delta\ndata: {}\n\nevent: done\ndata: {}\n\n",)], "frame string")
    assert [r.event for r in answers.parse_events(frame).collect()] == ["delta", "done"]


def test_uploads(spark):
    rows = spark.createDataFrame([("notes.md", None), ("x.pdf", "text/plain"), ("picture.png", "image/png"), ("a/b.PDF", None), (None, "text/markdown")], "f string, m string")
    got = rows.select(files.classify(F.col("f"), F.col("m")).alias("k"), files.title(F.col("f"), F.lit("id")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("direct", "notes"), ("direct", "x"), (None, "picture"), ("pdf", "b"), ("direct", "uploaded-document")]


def test_store(spark, tmp_path):
    table = store.ParquetTable(spark, f"file://{tmp_path}/t", store._fields("id status", "n"), ["id"])
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([("a", "new", 1, 0), ("a", "ready", 2, 1), ("b", "new", 1, 0)], "id string, status string, n int, _seq int"))
    table.upsert(spark.createDataFrame([("b", "failed", 5, 0)], "id string, status string, n int, _seq int"))
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", "ready", 2), ("b", "failed", 5)]
    table.delete_documents(spark.createDataFrame([("a",)], "document_id string"), "id")
    assert [r.id for r in table.read().collect()] == ["b"]


def test_layout(spark):
    def block(x, y, text, size, x1=None):
        return (0, [x, y, x1 or x + 150.0, y + 20.0], [([(text, size)],)])

    long = "plain body text that is long enough"
    pages = [("d", 1, 595.0, [block(72.0, 50.0, "Heading", 24.0, 500.0), block(320.0, 100.0, "right " + long, 11.0), block(72.0, 120.0, "left " + long, 11.0), block(72.0, 160.0, long, 11.0)]), ("d", 2, 595.0, [])]
    md = layout.pages_to_markdown(spark.createDataFrame(pages, layout.PAGES)).first().markdown
    assert md == f"<!-- page: 1 -->\n\n# Heading\n\nleft {long}\n\n{long}\n\nright {long}\n\n<!-- page: 2 -->\n\n" + layout.SCANNED_NOTE % 2


def test_stream(spark, tmp_path):
    from pagewright.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/notes.md").write_text("# T\n\n## S\n\nhello there\n")
    (tmp_path / "in/pic.png").write_bytes(b"\x89PNG")
    ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    rows = spark.read.parquet(f"{tmp_path}/out/chunks").collect()
    assert [(r.title, r.section) for r in rows] == [("notes", "S")]
    assert spark.read.parquet(f"{tmp_path}/out/vectors").count() == 1
