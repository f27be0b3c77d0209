from pyspark.sql import functions as F

from pagewright.operators import search
from pagewright.streaming import ingest


def _recounted(spark, target, query, limit):
    rows = ingest.live(spark, target, "postings")
    terms = query.split()
    return {r.chunk_id: (r.score, r["rank"]) for r in search.score_postings(rows.filter(F.col("term").isin(terms)), rows, "chunk_id", limit).collect()}


def test_statistics_follow_changes_and_deletes(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    for i in range(6):
        (source / f"d{i}.md").write_text(f"# t\n\n## s\n\nalpha beta {'gamma ' * i} word{i}\n\n## more\n\n{'alpha ' * (i + 1)}")
    (source / "empty.txt").write_text("...")
    retriever = ingest.retriever(spark, target)

    def check():
        got = {r.chunk_id: (r.score, r["rank"]) for r in retriever.keywords("alpha gamma", 20).collect()}
        assert got and got == _recounted(spark, target, "alpha gamma", 20)
        return got

    ingest.ingest_files(spark, str(source), target)
    first = check()
    (source / "d1.md").write_text("gamma gamma delta and nothing else")
    ingest.ingest_files(spark, str(source / "d1.md"), target)
    second = check()
    gone = ingest.current_documents(spark, target).filter("title = 'd4'").first().document_id
    assert ingest.delete_document(spark, target, gone)
    third = check()
    assert first != second != third and len(third) < len(second)
    plan = retriever.keywords("alpha", 5)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:] if "term:string" in x.split("ReadSchema")[1].split(">")[0]]
    assert scans and all("(term,alpha)" in x.split("PushedFilters")[1].split("ReadSchema")[0] for x in scans)
