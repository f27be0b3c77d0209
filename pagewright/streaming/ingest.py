"""Ingestion of a folder as a stream, the tables it fills, and what reads and deletes there.

Each micro-batch writes to a folder of its own in every table, so one that runs again replaces what it wrote before. A
document keeps its id when its file changes: rows of the batch that was written last count, unless that batch failed or the document
has been deleted since. One bad document is a failed job and no more.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions.scalars import failure_reason
from pagewright.operators import providers, search
from pagewright.operators.chunking import chunk_documents, chunk_records, index_payload
from pagewright.sources.files import artifacts, delete_files, identified, read_files, rejected, save_files

#: Tables whose rows count only while a document's last batch names them; the others are history.
BATCHED = ("texts", "chunks", "vectors", "keywords", "postings", "lengths")
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def index_batch(chunks: DataFrame, embedding) -> dict[str, DataFrame]:
    """The three tables of stored chunks: chunk records, vectors with payload, keyword documents."""
    payload = index_payload(chunks)
    vectors = embedding.vectors(chunks, "chunk_id", F.col("text"))
    return {
        "chunks": chunk_records(chunks),
        "vectors": payload.join(vectors, "chunk_id").select(F.col("payload.docId").alias("document_id"), "point_id", "vector", "payload"),
        "keywords": payload.select(F.col("payload.docId").alias("document_id"), "keyword.*"),
    }


def document_lengths(chunks: DataFrame) -> DataFrame:
    """(document_id, n, words): a document's chunks that have terms and the terms in them. Sums over the documents that
    count at a time are the corpus statistics of that time, whatever was replaced or deleted."""
    size = F.size(search.keyword_tokens(F.col("text"))).cast("long")
    return chunks.select("document_id", size.alias("dl")).filter("dl > 0").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words"))


def job_rows(documents: DataFrame, failures: DataFrame, batch: str, at: int) -> tuple[DataFrame, DataFrame]:
    """Document rows and job rows of a batch: (document_id, title, file_path) and the failures' (document_id, error)."""
    first = failures.groupBy("document_id").agg(F.min("error").alias("error"))
    found = documents.join(first, "document_id", "left").withColumn("at", F.lit(at).cast("long"))
    bad = F.col("error").isNotNull()
    made = found.select("document_id", "title", F.when(bad, "failed").otherwise("ready").alias("status"), "file_path", "at")
    name = F.sha2(F.concat_ws(":", "document_id", F.lit(batch)), 256)
    jobs = found.select(name.alias("id"), "document_id", F.when(bad, "failed").otherwise("completed").alias("status"), failure_reason(F.col("error")).alias("failure_reason"), F.lit(0).alias("retry_count"), "at")
    return made, jobs


def ingest_batch(files: DataFrame, name: str, target: str, pages: DataFrame | None = None, embedding=None, chunker=None, store: str | None = None) -> None:
    """The batch of that name, of (document_id, filename, content): rejected files, raw files, chunks (made once and read again), the
    search tables, then job and document rows, which make the batch visible."""
    spark = files.sparkSession
    embedding = embedding or providers.HashEmbedding()

    def stored(table: str, rows: DataFrame) -> DataFrame:
        path = f"{target}/{table}/batch={name}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    stored("rejected", rejected(files))
    documents = artifacts(files, pages)
    saved = stored("saved", save_files(files.join(rejected(files).select("document_id"), "document_id", "left_anti"), store or f"{target}/files"))
    good = documents.filter("error is null")
    chunks = stored("texts", chunk_documents(good, chunker=chunker, keep_errors=True))
    problems = chunks.filter("chunk_index is null").select("document_id", "error")
    failures = documents.select("document_id", "error").unionByName(problems).unionByName(saved.select("document_id", "error")).filter("error is not null")
    failures = stored("failures", failures)
    sound = chunks.filter("chunk_index is not null").drop("error").join(failures.select("document_id").distinct(), "document_id", "left_anti")
    for table, rows in index_batch(sound, embedding).items():
        stored(table, rows)
    stored("postings", search.postings(sound.select("document_id", "chunk_id", "text"), "chunk_id", F.col("text")).join(sound.select("chunk_id", "document_id"), "chunk_id"))
    stored("lengths", document_lengths(sound))
    made, jobs = job_rows(documents.select("document_id", "title").join(saved.select("document_id", "file_path"), "document_id", "left"), failures, name, time.time_ns())
    stored("jobs", jobs)
    stored("documents", made)


def ingest_files(spark: SparkSession, path: str, target: str, pages: DataFrame | None = None, embedding=None, chunker=None) -> None:
    """Ingests the files of a folder or a file once more, such as those that have changed under their path, which a stream
    does not see."""
    ingest_batch(read_files(spark, path), f"m{uuid.uuid4().hex}", target, pages, embedding, chunker)


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, pages: DataFrame | None = None, embedding=None, chunker=None) -> StreamingQuery:
    """Reads new files of ``source`` until none is left. ``pages``: the converter's page table for PDFs;
    ``embedding``: what has ``vectors(rows, key, text)``, the hash embedding by default."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        ingest_batch(identified(batch), f"s{number}", target, pages, embedding, chunker)
        batch.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _table(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{target}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(made)


def current_documents(spark: SparkSession, target: str) -> DataFrame:
    """(document_id, title, status, file_path, batch, at) of every document's last batch; deleted ones are absent."""
    rows = _table(spark, target, "documents")
    last = rows.groupBy("document_id").agg(F.max_by(F.struct("title", "status", "file_path", "batch", "at"), "at").alias("d")).select("document_id", "d.*")
    if not _exists(spark, f"{target}/deleted"):
        return last
    gone = _table(spark, target, "deleted").groupBy("document_id").agg(F.max("upto").alias("upto"))
    return last.join(gone, "document_id", "left").filter("upto is null or at > upto").drop("upto")


def live(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The rows of a table that count: of ready documents, from their latest batch."""
    ready = current_documents(spark, target).filter("status = 'ready'").select("document_id", "batch")
    return _table(spark, target, name).join(ready, ["document_id", "batch"], "left_semi")


def delete_document(spark: SparkSession, target: str, document_id: str) -> bool:
    """Deletes a document in every table and its files; False where there is none of that id."""
    found = current_documents(spark, target).filter(F.col("document_id") == document_id).select("document_id", F.col("at").alias("upto"))
    if found.isEmpty():
        return False
    found.write.parquet(f"{target}/deleted/at={time.time_ns()}")
    delete_files(f"{target}/files", document_id)
    return True


def vacuum(spark: SparkSession, target: str) -> list[str]:
    """Removes, and names, the batch folders that no present document's last batch needs: those of a batch that failed
    before its documents were written, and those whose documents have all been replaced or deleted. One folder of a table
    always stays, for its schema. To be run while nothing is ingested or searched; batches are few, so their names are collected."""
    used = set()
    if _exists(spark, f"{target}/documents"):
        used = {f"batch={r[0]}" for r in current_documents(spark, target).filter("status = 'ready'").select("batch").distinct().collect()}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for table in BATCHED:
        folder = path(f"{target}/{table}")
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.startswith("batch=")]
        spare = [n for n in names if n not in used]
        for name in spare if len(spare) < len(names) else spare[1:]:
            fs.delete(path(f"{target}/{table}/{name}"), True)
            gone.append(f"{table}/{name}")
    return gone


def retriever(spark: SparkSession, target: str, embedding=None, reranker=None, rrf_k: int = search.RRF_K, rerank_top_k: int = 20) -> search.Retriever:
    """Hybrid search over what was ingested: stored vectors and stored postings, no text is read but the hits'."""
    embedding = embedding or providers.HashEmbedding()

    def vectors(asked: DataFrame, limit: int) -> DataFrame:
        points = live(spark, target, "vectors")
        top = search.vector_topk(points.select("point_id", "vector"), asked, "point_id", limit)
        return search.vector_hits(points.select("point_id", "payload").join(F.broadcast(top), "point_id"))

    def keywords(query: str, limit: int) -> DataFrame:
        rows = live(spark, target, "postings")
        lengths = live(spark, target, "lengths").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
        terms = [x[0] for x in spark.range(1).select(F.explode(search.keyword_tokens(F.lit(query)))).distinct().collect()]
        top = search.score_with(rows.filter(F.col("term").isin(terms)), lengths, "chunk_id", limit)
        documents = live(spark, target, "keywords")
        return search.keyword_hits(documents.select("_id", "document").join(F.broadcast(top), F.col("_id") == F.col("chunk_id")))

    return search.Retriever(vectors, keywords, embedding, reranker, rrf_k, rerank_top_k)
