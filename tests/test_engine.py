"""Settings, providers, stored search, ingestion with its jobs and failures, and faults of the first round."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.operators import answers, chunking, layout, providers, search, store
from pagewright.plans.settings import Settings, make_answers, make_embedding, make_reranker
from pagewright.sources import files
from pagewright.streaming import ingest


def _hits(spark, n=4):
    rows = [(f"d{i}", f"c{i}", "t", None, None, f"text {i}", 1.0 / i, i, "rrf") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "document_id string, chunk_id string, title string, section string, page int, text string, score double, rank int, source string")


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nRRF_K=7\nRERANKER_ENABLED=false\nOTHER=1\nLLM_MODEL='m'\n")
    s = Settings.load({"RRF_K": "9", "UNKNOWN": "x"}, str(tmp_path / ".env"))
    assert (s.rrf_k, s.reranker_enabled, s.llm_model, s.embedding_dimensions) == (9, False, "m", 512)
    assert make_reranker(s) is None and isinstance(make_answers(s), answers.PlainAnswers)
    with pytest.raises(ValueError, match="EMBEDDING_API_KEY"):
        make_embedding(Settings(embedding_provider="openai", embedding_api_base_url="http://e"))
    assert isinstance(make_embedding(Settings()), providers.HashEmbedding)
    api = Settings(reranker_provider="api", embedding_api_key="k")
    assert make_reranker(api) is None
    assert make_reranker(Settings(reranker_provider="api", embedding_api_key="k", reranker_api_base_url="http://r/")).base_url == "http://r"
    assert isinstance(make_answers(Settings(llm_api_base_url="http://l", llm_api_key="k", llm_model="m")), answers.ModelAnswers)
    with pytest.raises(ValueError, match="api_key"):
        providers.ServiceReranker("http://r", "", "m")


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "aa"), (2, None), (3, "b")], "k long, t string")
    local = providers.LocalEmbedding(lambda: lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts], 2)
    got = {r.k: r.vector for r in local.vectors(rows, "k", F.col("t")).collect()}
    assert np.allclose(got[1], [0.6, 0.8]) and got[2] == [0.0, 0.0]

    def transport(url, key, body, timeout):
        assert (url, key, body["model"]) == ("http://e/embeddings", "k", "m")
        return {"data": [{"embedding": [0.0, 2.0]} for _ in body["input"]]}

    service = providers.ServiceEmbedding("http://e/", "k", "m", 2, transport=transport)
    assert [r.vector for r in service.vectors(rows, "k", F.col("t")).collect()] == [[0.0, 1.0]] * 3


def test_rerankers(spark):
    hits = _hits(spark)
    yes = {1: 0.1, 2: 0.9, 3: 0.5, 4: 0.9}

    def score(prompts):
        assert len(prompts) <= providers.RERANK_BATCH and all(p.startswith(answers.RERANK_PREFIX) and "<Query>: q\n" in p for p in prompts)
        return [[0.0, np.log(yes[int(p.split("text ")[1][0])])] for p in prompts]

    got = providers.CrossEncoder(score).rerank(hits, "q", 3).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"], r.source) for r in got] == [("c2", 1, "reranked"), ("c4", 2, "reranked"), ("c3", 3, "reranked")]
    asked = []

    def transport(url, key, body, timeout):
        asked.append(body)
        return {"results": [{"index": 2, "relevance_score": 0.7}, {"index": 9}, {"index": 2}, {"index": 0, "score": 0.2}]}

    got = providers.ServiceReranker("http://r", "k", "m", transport=transport).rerank(hits, "q", 3).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 3)) for r in got] == [("c3", 0.7), ("c1", 0.2), ("c2", 0.5)]
    assert asked[0]["documents"] == [f"text {i}" for i in range(1, 5)] and asked[0]["top_n"] == 3

    def down(*a):
        raise OSError("no route")

    kept = providers.ServiceReranker("http://r", "k", "m", transport=down).rerank(hits, "q", 2).collect()
    assert [(r.chunk_id, r.source) for r in kept] == [("c1", "rrf"), ("c2", "rrf")]


def test_model_answers(spark):
    hits = _hits(spark, 2)
    sent = []

    def transport(url, key, body, timeout):
        sent.append((url, body))
        return {"choices": [{"message": {"content": " it is so [1] "}}]}

    lines = ['data: {"choices":[{"delta":{"content":"a"}}]}', "", ": note", 'data: {"choices":[{"delta":{}}]}']
    model = answers.ModelAnswers("http://l/", "k", "m", transport, lambda *a: iter([*lines, "data: [DONE]", "data: x"]))
    assert model.answer(hits, "q") == "it is so [1]" and list(model.stream(hits, "q")) == ["a"]
    url, body = sent[0]
    assert url == "http://l/chat/completions" and body["temperature"] == 0.2
    assert body["messages"][0]["content"] == answers.SYSTEM_PROMPT
    context = "[1] (chunk_id=c1) text 1\n\n[2] (chunk_id=c2) text 2"
    assert body["messages"][1] == {"role": "user", "content": f"Context:\n{context}\n\nQuestion: q"}

    def down(*a):
        raise OSError

    def half(*a):
        yield from lines
        raise OSError

    broken = answers.ModelAnswers("http://l", "k", "m", down, half)
    fallback = f"{answers.UNREACHABLE}\n\n{context}"
    assert broken.answer(hits, "q") == fallback and list(broken.stream(hits, "q")) == ["a", fallback]
    none = hits.filter("false")
    assert broken.answer(none, "q") == "No local context found for: q" == next(broken.stream(none, "q"))
    assert "".join(answers.PlainAnswers().stream(hits, "q")) == answers.PlainAnswers().answer(hits, "q")


def test_hit_mappers_and_fusion(spark):
    kind = "struct<docId:string,chunkId:string,title:string,section:string,page:int,text:string>"
    points = spark.createDataFrame([("p1", ("d", None, None, "s", 3, "x"), None, 1), ("p2", ("d", "c2", "t", None, None, None), 0.5, 2)], f"point_id string, payload {kind}, score double, rank int")
    a, b = search.vector_hits(points).orderBy("rank").collect()
    assert (a.chunk_id, a.title, a.score, a.page, a.source) == ("p1", "", 0.0, 3, "vector") and b.text == ""
    found = spark.createDataFrame([("c2", ("d", None, "other", None, None, "kw"), 2.0, 1)], f"_id string, document {kind}, score double, rank int")
    fused = search.fuse_hits([search.vector_hits(points), search.keyword_hits(found)], 60, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.title, r.source) for r in fused] == [("c2", "t", "rrf"), ("p1", "", "rrf")]
    assert search.rrf_fuse([], "chunk_id").count() == 0


def test_rrf_equals_a_loop(spark):
    rng = random.Random(9)
    lists = [rng.sample([f"c{i:02d}" for i in range(30)], 12) for _ in range(4)]
    frames = [spark.createDataFrame([(c, r) for r, c in enumerate(ids, 1)], "chunk_id string, rank int") for ids in lists]
    score, seen = {}, {}
    for i, ids in enumerate(lists):
        for r, c in enumerate(ids, 1):
            score[c] = score.get(c, 0) + 1 / (7 + r)
            seen.setdefault(c, (i, r))
    want = sorted(score, key=lambda c: (-round(score[c], 6), seen[c]))[:10]
    assert [r.chunk_id for r in search.rrf_fuse(frames, "chunk_id", 7, 10).orderBy("rank").collect()] == want


def test_width_folding(spark):
    row = spark.range(1).select(search.keyword_tokens(F.lit("Ｒｅｄｉｓ ４２ ｶﾞｲﾄﾞ ﾃﾞｰﾀ")).alias("t")).first()
    assert row.t == ["redis", "42", "ガイ", "イド", "デー", "ータ"]


def test_topk_without_keys_or_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, query_vector array<double>")
    assert [(r.query_id, r.id) for r in search.vector_topk_multi(v, q, "id", 5).orderBy("rank").collect()] == [(7, 1), (7, 3)]
    assert [r.id for r in search.vector_topk(v, q.filter("query_id = 7"), "id", 5).orderBy("rank").collect()] == [1, 3]
    assert search.vector_topk(v, q.filter("query_id = 8"), "id", 5).count() == 0


def test_stored_postings_are_read_by_term(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))) for i in range(200)] + [(200, None)], "id long, text string")
    search.write_postings(rows, "id", F.col("text"), str(tmp_path))
    for query in ("w1 w2", "w3", "absent", ""):
        a = search.stored_bm25(spark, str(tmp_path), "id", query, 10).orderBy("rank").collect()
        b = search.bm25_topk(rows, "id", F.col("text"), query, 10).orderBy("rank").collect()
        assert [(r.id, r.score) for r in a] == [(r.id, r.score) for r in b]
    read = search.read_postings(spark, str(tmp_path), ["w1"])
    assert len(read.inputFiles()) <= len(spark.read.parquet(f"{tmp_path}/postings").inputFiles()) and "PartitionFilters: [bucket" in read._jdf.queryExecution().toString().replace("isnotnull(bucket", "bucket")
    assert read.select("bucket").distinct().count() == 1


def test_token_count_equals_a_loop(spark):
    rng = random.Random(6)
    letters = "ab1 .-é中文字한글、，𠀋\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 50))) for _ in range(200)]

    def loop(text):
        wide = sum(any(a <= ord(c) <= b for a, b in scalars.CJK_RANGES) for c in text)
        return wide + -(-(len(text) - wide) // 4)

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.token_count(F.col("t")).alias("n")).collect()
    assert all(r.n == loop(r.t) == chunking.count_tokens(r.t) for r in got)


def test_layout_faults(spark):
    def block(x, y, spans):
        return (0, [x, y, x + 150.0, y + 20.0], [(spans,)])

    body = "plain body text that is long enough"
    empty = (0, [400.0, 10.0, 500.0, 30.0], [([("  ", 11.0)],)])
    pages = [("d", 1, 595.0, [empty, block(72.0, 90.0, [("\tbelow " + body + " ", 10.0)]), block(72.0, 50.0, [(body, 10.0)])]), ("d", 2, 595.0, [block(72.0, 50.0, [("x" * 3, 40.0), ("y", 40.0), ("z", 40.0)])])]
    md = layout.pages_to_markdown(spark.createDataFrame(pages, layout.PAGES)).first().markdown
    assert md == f"<!-- page: 1 -->\n\n{body}\n\nbelow {body}\n\n<!-- page: 2 -->\n\n" + layout.SCANNED_NOTE % 2


def test_store_faults(spark, tmp_path):
    kind = store._fields("id status")
    changes = lambda *rows: spark.createDataFrame(rows, "id string, status string, _seq int")
    table = store.ParquetTable(spark, f"file://{tmp_path}/t", kind, ["id"])
    table.upsert(changes((None, "new", 0), ("a", "new", 0)))
    table.upsert(changes((None, "ready", 0)))
    table.upsert(changes(("a", "failed", 0)))
    assert sorted((r.id or "", r.status) for r in table.read().collect()) == [("", "ready"), ("a", "failed")]
    assert len(list((tmp_path / "t").iterdir())) == 3  # two versions and the pointers
    docs = spark.createDataFrame([("a", "ready"), ("b", "processing")], "id string, status string")
    assert store.poll_state(docs, "a").count() == 1 and store.poll_state(docs, "b").count() == 0
    failed = store.failed_job(docs, F.lit("x" * 2000)).first()
    assert failed.status == "failed" and len(failed.failure_reason) == 1000


def test_renders(spark):
    rows = spark.createDataFrame([(None, None), ("s", 0), ("s", 3)], "section string, page int")
    assert [r[0] for r in rows.select(answers.render_citation(F.col("section"), F.col("page"))).collect()] == ["Untitled section", "s", "s, page 3"]


def test_stream_with_failures_changes_and_pages(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "good.md").write_text("# T\n\n## Lock\n\nalpha beta words\n")
    (source / "bad.md").write_text("poison")
    (source / "pic.png").write_bytes(b"\x89PNG")
    (source / "a.pdf").write_bytes(b"%PDF")
    (source / "b.pdf").write_bytes(b"%PDF")
    ids = {r.filename.rsplit("/", 1)[1]: r.document_id for r in files.read_files(spark, str(source)).collect()}
    body = "gamma words in a page that is long enough"
    pages = spark.createDataFrame([(ids["a.pdf"], 1, 595.0, [(0, [72.0, 50.0, 300.0, 70.0], [([(body, 11.0)],)])])], layout.PAGES)

    def chunker(markdown, most, overlap):
        if "poison" in markdown:
            raise ValueError("spoiled " * 300)
        return chunking.chunk_markdown(markdown, most, overlap)

    run = lambda: ingest.ingest_stream(spark, str(source), target, str(tmp_path / "cp"), pages, chunker=chunker).awaitTermination(120)
    run()
    state = {r.document_id: r.status for r in ingest.current_documents(spark, target).collect()}
    assert state == {ids["good.md"]: "ready", ids["bad.md"]: "failed", ids["a.pdf"]: "ready", ids["b.pdf"]: "failed"}
    jobs = {r.document_id: r for r in spark.read.parquet(f"{target}/jobs").collect()}
    assert jobs[ids["bad.md"]].status == "failed" and len(jobs[ids["bad.md"]].failure_reason) == 1000 and jobs[ids["good.md"]].status == "completed"
    assert [r.filename.rsplit("/", 1)[1] for r in spark.read.parquet(f"{target}/rejected").collect()] == ["pic.png"]
    assert (tmp_path / "out/files" / ids["good.md"] / "good.md").read_text().startswith("# T")
    found = ingest.retriever(spark, target).search(spark, "alpha", 5).orderBy("rank").collect()
    assert found[0].document_id == ids["good.md"] and found[0].section == "Lock" and found[0].source == "rrf"
    assert ingest.retriever(spark, target).search(spark, "gamma", 5).orderBy("rank").first().page == 1
    (source / "good.md").unlink()
    (source / "good.md").write_text("# T\n\n## Lock\n\nomega instead, and a longer text\n")
    ingest.ingest_files(spark, str(source / "good.md"), target, pages)
    texts = [r.document.text for r in ingest.live(spark, target, "keywords").collect()]
    assert len(texts) == 2 and any("omega" in t for t in texts) and not any("alpha" in t for t in texts)
    assert ingest.delete_document(spark, target, ids["good.md"]) and not ingest.delete_document(spark, target, ids["good.md"])
    assert not ingest.delete_document(spark, target, "none")
    assert {r.document_id for r in ingest.live(spark, target, "vectors").collect()} == {ids["a.pdf"]}
    assert not (tmp_path / "out/files" / ids["good.md"]).exists()
    assert json.loads(spark.range(1).select(F.to_json(F.struct(F.lit(1).alias("a")))).first()[0]) == {"a": 1}
