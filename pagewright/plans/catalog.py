"""Named queries of the retrieval engine over the driver's tables, and the SQL that checks them.

The driver's ``documents`` have no titles, states or times, so these follow from ``doc_id`` by fixed rules; markdown with
sections and pages is assembled from ``conversations``.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.operators import answers, buckets, chunking, layout, search, store, stored, vector_index
from pagewright.sources import files
from pagewright.streaming import ingest

FLAGSHIP = "hybrid_search"
QUERY = "anon tion ble whou"
TERMS = ("anon", "tion", "ble", "whou")
INT = "bigint"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    state = F.when(d % 7 == 0, "failed").when(d % 5 == 0, "processing").otherwise("ready")
    return _read(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"), F.concat(F.lit("doc-"), d.cast("string")).alias("title"), F.concat(F.lit("doc-"), d.cast("string"), F.lit(".md")).alias("original_filename"),
        F.lit("text/markdown").alias("mime_type"), state.alias("status"), F.lit(1).alias("version"), F.timestamp_seconds(d * 60).alias("created_at"), F.timestamp_seconds(d * 60 + 5).alias("updated_at"),
    )


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    part = F.concat(F.lit("<!-- page: "), (F.col("turn") + 1).cast("string"), F.lit(" -->\n\n## "), F.col("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x.part), "\n\n")
    return turns.groupBy("conv_id").agg(F.concat(F.lit("# Conversation\n\n"), body).alias("markdown")).select(F.col("conv_id").cast("string").alias("document_id"), F.lit("conversation").alias("title"), "markdown")


def token_count(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", scalars.token_count(F.col("text")).cast(INT).alias("n_tokens"), scalars.cjk_count(F.coalesce("text", F.lit(""))).cast(INT).alias("n_cjk"))


def chunk_identity(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", scalars.stable_chunk_id(F.col("doc_id").cast("string"), F.lit(1)).alias("chunk_id"), "text")
    return rows.select("doc_id", "chunk_id", scalars.point_id(F.col("chunk_id")).alias("point_id"), scalars.text_checksum(F.col("text")).alias("checksum"))


def sentence_units(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(scalars.sentence_units(F.col("text"))).alias("pos", "unit")).select("doc_id", F.col("pos").cast(INT).alias("pos"), "unit")


def pack_chunks(spark, sf_dir):
    made = chunking.chunk_documents(_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.lit("").alias("title"), F.col("text").alias("markdown")))
    return chunking.chunk_records(made)


def chunk_markdown(spark, sf_dir):
    return chunking.chunk_records(chunking.chunk_documents(_markdown(spark, sf_dir)))


def index_payload(spark, sf_dir):
    return chunking.index_payload(chunking.chunk_documents(_markdown(spark, sf_dir))).select("chunk_id", "point_id", F.to_json("payload").alias("payload"), F.to_json("keyword").alias("keyword"))


def hash_embed(spark, sf_dir):
    made = search.hash_embedding(_documents(spark, sf_dir), "doc_id", F.col("text"))
    return made.select("doc_id", F.posexplode("vector").alias("dim", "x")).select("doc_id", F.col("dim").cast(INT).alias("dim"), F.round("x", 6).alias("x"))


def _vectors(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def vector_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.vector_topk(v, v.filter("vec_id = 0").select(F.col("vector").alias("query_vector")), "vec_id", 10).withColumn("rank", F.col("rank").cast(INT))


def vector_topk_multi(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return search.vector_topk_multi(v, asked, "vec_id", 10).withColumn("rank", F.col("rank").cast(INT))


def vector_index_topk(spark, sf_dir):
    """Every twentieth vector as a query against the stored index, all of its cells probed."""
    path, v = f"{stored.scratch_dir(spark)}/cells-{uuid.uuid4().hex}", _vectors(spark, sf_dir)
    vector_index.build(v, "vec_id", path)
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return vector_index.search(spark, path, "vec_id", asked, 10, vector_index.MAX_CELLS).withColumn("rank", F.col("rank").cast(INT))


def bm25_topk(spark, sf_dir):
    return search.bm25_topk(_documents(spark, sf_dir), "doc_id", F.col("text"), QUERY, 10).withColumn("rank", F.col("rank").cast(INT))


def _hits(spark, sf_dir):
    return search.hybrid_search(_documents(spark, sf_dir), "doc_id", F.col("text"), QUERY)


def hybrid_search(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("rank", F.col("rank").cast(INT))


def rrf_fuse(spark, sf_dir):
    d = _documents(spark, sf_dir)
    a = search.bm25_topk(d, "doc_id", F.col("text"), "anon tion", 20)
    b = search.bm25_topk(d, "doc_id", F.col("text"), "ble whou", 20)
    return search.rrf_fuse([a, b], "doc_id").withColumn("rank", F.col("rank").cast(INT))


def _cited(spark, sf_dir):
    payload = _documents(spark, sf_dir).select("doc_id", scalars.stable_chunk_id(F.col("doc_id").cast("string"), F.lit(1)).alias("chunk_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), "text")
    return search.citations(_hits(spark, sf_dir), payload, "doc_id")


def citations(spark, sf_dir):
    return _cited(spark, sf_dir).select(F.col("rank").cast(INT).alias("rank"), "doc_id", "chunk_id", "title", "score", scalars.text_checksum(F.col("text")).alias("checksum"))


def simple_answer(spark, sf_dir):
    return answers.simple_answer(_cited(spark, sf_dir), QUERY)


def sse_frames(spark, sf_dir):
    return answers.stream_events(_cited(spark, sf_dir), QUERY)


def _points(spark, sf_dir):
    d = F.col("doc_id")
    payload = F.struct(
        F.when(d % 3 != 0, F.concat(F.lit("doc-"), (d % 10).cast("string"))).alias("docId"), F.when(d % 4 != 0, F.concat(F.lit("chunk-"), d.cast("string"))).alias("chunkId"), F.when(d % 5 != 0, "title").alias("title"),
        F.when(d % 2 == 0, "part").alias("section"), F.when(d % 7 < 5, (d % 7).cast("int")).alias("page"), F.col("text"),
    )
    return _read(spark, sf_dir, "documents").select(d, payload.alias("payload"), F.when(d % 6 != 0, d / 8).alias("score"), d.alias("rank"))


def _mapped(hits):
    return hits.select("document_id", "chunk_id", "title", "section", F.coalesce(F.col("page"), F.lit(-1)).cast(INT).alias("page"), F.length("text").cast(INT).alias("n_chars"), "score", "source", F.col("rank").cast(INT).alias("rank"))


def vector_hits(spark, sf_dir):
    return _mapped(search.vector_hits(_points(spark, sf_dir).withColumn("point_id", F.concat(F.lit("p-"), F.col("doc_id").cast("string")))))


def keyword_hits(spark, sf_dir):
    return _mapped(search.keyword_hits(_points(spark, sf_dir).select(F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("_id"), F.col("payload").alias("document"), "score", "rank")))


def payload_filter(spark, sf_dir):
    return store.payload_filter(_points(spark, sf_dir), "docId", "doc-4").select("doc_id")


def term_filter(spark, sf_dir):
    return store.term_filter(_points(spark, sf_dir).withColumnRenamed("payload", "document"), "section", "part").select("doc_id")


def render_citation(spark, sf_dir):
    return _points(spark, sf_dir).select("doc_id", answers.render_citation(F.col("payload.section"), F.col("payload.page")).alias("shown"))


def prompt_messages(spark, sf_dir):
    made = answers.messages(_cited(spark, sf_dir), QUERY).select(F.explode("messages").alias("m"))
    return made.select("m.role", "m.content")


def poll_state(spark, sf_dir):
    rows = _titled(spark, sf_dir)
    return store.poll_state(rows, "7").unionByName(store.poll_state(rows, "1")).unionByName(store.poll_state(rows, "5"))


def job_log(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("t").alias("title"), F.lit("p").alias("file_path"), "doc_id", "text")
    failures = d.filter("doc_id % 7 = 0").select("document_id", F.coalesce("text", F.lit("no text")).alias("error"))
    documents, jobs = ingest.job_rows(d, failures, "s0", 1)
    return jobs.select("document_id", "status", F.length(F.coalesce("failure_reason", F.lit(""))).cast(INT).alias("reason_chars"), "id").join(documents.select("document_id", F.col("status").alias("document_status")), "document_id")


def index_search(spark, sf_dir):
    path = f"{stored.scratch_dir(spark)}/postings-{uuid.uuid4().hex}"
    search.write_postings(_documents(spark, sf_dir), "doc_id", F.col("text"), path)
    return search.stored_bm25(spark, path, "doc_id", QUERY, 10).withColumn("rank", F.col("rank").cast(INT))


def width_fold(spark, sf_dir):
    wide = F.translate("text", "abcdefghijklmnopqrstuvwxyz0123456789", "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz0123456789"))
    return _documents(spark, sf_dir).select("doc_id", F.sha2(F.coalesce(search.fold_width(wide), F.lit("")), 256).alias("folded_sha256"))


def pdf_reading_order(spark, sf_dir):
    """Pages in two columns made of the first letters of documents, five blocks a page, of sizes that make headings."""
    d = F.col("doc_id")
    text = F.concat(F.lit("block "), d.cast("string"), F.lit(" has some words"))
    side = F.when(d % 2 == 0, 50.0).otherwise(320.0)
    block = F.struct(F.lit(0).alias("type"), F.array(side, (d % 5 * 20 + 10).cast("double"), side + 200, (d % 5 * 20 + 25).cast("double")).alias("bbox"), F.array(F.struct(F.array(F.struct(text.alias("text"), F.when(d % 10 == 3, 24.0).otherwise(10.0).alias("size"))).alias("spans"))).alias("lines"))
    rows = _read(spark, sf_dir, "documents").select((d - d % 50).cast("string").alias("document_id"), (d % 50 / 5).cast("int").alias("page0"), d, block.alias("block"))
    pages = rows.groupBy("document_id", (F.col("page0") + 1).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "block"))), lambda x: x.block).alias("blocks"))
    return layout.pages_to_markdown(pages.select("document_id", "page", F.lit(595.0).alias("width"), "blocks"))


def rerank_merge(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("source", F.lit("rrf"))
    result = spark.sql("SELECT * FROM VALUES (0, 4, 0.9D), (1, 2, 0.8D), (2, 4, 0.7D), (3, NULL, 0.6D), (4, 99, 0.5D), (5, 0, 0.4D) AS r(pos, index, relevance_score)")
    return answers.merge_rerank_result(hits, result, 6).withColumn("rank", F.col("rank").cast(INT))


def rerank_overlap(spark, sf_dir):
    words = F.array(*[F.lit(t) for t in TERMS])
    overlap = lambda q, text: F.size(F.array_intersect(search.keyword_tokens(text), words)) / F.lit(float(len(TERMS)))
    return answers.rerank(_cited(spark, sf_dir), overlap, QUERY, 5).select("doc_id", "score", F.col("rank").cast(INT).alias("rank"), "source")


def list_documents(spark, sf_dir):
    return store.list_documents(_titled(spark, sf_dir)).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at")})


def ready_counts(spark, sf_dir):
    return store.ready_counts(_titled(spark, sf_dir))


def upsert_latest(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    again = d.filter("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), F.lit(1).alias("_seq"))
    new = d.filter("doc_id % 6 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "n_chars", F.lit(2).alias("_seq"))
    last = d.filter("doc_id % 9 = 0").select("doc_id", (F.col("n_chars") + 7).alias("n_chars"), F.lit(3).alias("_seq"))
    return store.upsert(d, again.unionByName(new).unionByName(last), ["doc_id"])


def bucket_commits(spark, sf_dir):
    """Documents and turns in one bucketed store: all rows, then one commit of changed texts, then one that deletes
    documents with their turns, then one that fails before its end and changes nothing."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    turns = turns.select(F.col("conv_id").alias("doc_id"), "turn", "text")
    path = f"{stored.scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    kept = buckets.Store(spark, path, {"documents": (docs.schema, ["doc_id"]), "turns": (turns.schema, ["doc_id", "turn"])}, buckets=16)
    with kept.commit() as change:
        change.upsert("documents", docs)
        change.upsert("turns", turns)
    with kept.commit() as change:
        again = docs.filter("length(text) % 10 = 3")
        change.upsert("documents", again.select("doc_id", F.concat(F.lit("again "), "text").alias("text")))
    with kept.commit() as change:
        gone = docs.filter("length(text) % 7 = 0").select("doc_id")
        change.delete("documents", gone)
        change.delete("turns", gone)
    with contextlib.suppress(InterruptedError), kept.commit() as change:
        change.delete("documents", docs.select("doc_id"))
        raise InterruptedError
    one = lambda name, turn: kept.read(name).select(F.lit(name).alias("table_name"), "doc_id", turn.alias("turn"), F.md5("text").alias("digest"))
    return one("documents", F.lit(-1).cast("long")).unionByName(one("turns", F.col("turn")))


def cascade_delete(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    gone = d.filter("id % 10 = 3").select(F.col("id").alias("document_id"))
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), "turn")
    left = store.delete_documents({"documents": (d, "id"), "chunks": (turns, "document_id")}, gone)
    one = lambda name: left[name].agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
    return one("documents").unionByName(one("chunks"))


def job_state(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return store.latest(events, ["user_id"], "event_id")


def classify_upload(spark, sf_dir):
    d = F.col("doc_id")
    ends = F.array(*[F.lit(x) for x in (".md", ".MARKDOWN", ".txt", ".pdf", ".png", "")])
    rows = _read(spark, sf_dir, "documents").select(d, F.concat(F.lit("dir/doc-"), d.cast("string"), F.element_at(ends, (d % 6 + 1).cast("int"))).alias("filename"), F.when(d % 4 == 0, "text/plain").when(d % 4 == 1, "application/pdf").alias("mime"))
    return rows.select("doc_id", files.classify(F.col("filename"), F.col("mime")).alias("kind"), files.title(F.col("filename"), d.cast("string")).alias("title"))


def health(spark, sf_dir):
    n = lambda t: _read(spark, sf_dir, t).agg((F.count(F.lit(1)) > 0).alias("healthy")).select(F.lit(t).alias("store"), "healthy")
    return search.health(n("documents").unionByName(n("embeddings"))).select("status", F.to_json("stores").alias("stores"))


QUERIES = {f.__name__: f for f in (token_count, chunk_identity, sentence_units, pack_chunks, chunk_markdown, index_payload, hash_embed, vector_topk, vector_topk_multi, vector_index_topk, bm25_topk, rrf_fuse, hybrid_search, citations, simple_answer, sse_frames, vector_hits, keyword_hits, payload_filter, term_filter, render_citation, prompt_messages, poll_state, job_log, index_search, width_fold, pdf_reading_order, rerank_merge, rerank_overlap, list_documents, ready_counts, upsert_latest, bucket_commits, cascade_delete, job_state, classify_upload, health)}

_NON_CJK = f"[^{scalars.CJK_CLASS}]"
_STOP = "(" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + ")"


def _values(terms: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"('{t}')" for t in terms) + ") q(term)"


_WORDS = rf"SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w NOT IN {_STOP}) AS w FROM documents"


def _bm25(name: str, terms: tuple[str, ...], limit: int) -> str:
    """CTEs of the keyword list ``name`` (doc_id, score, rank)."""
    return f"""{name}_tf AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS w FROM words) WHERE w IN (SELECT term FROM {_values(terms)}) GROUP BY 1, 2),
{name}_s AS (SELECT t.doc_id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / s.avgdl))), 6) AS score
  FROM {name}_tf t JOIN (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term) d USING (term) JOIN lens l USING (doc_id), stats s GROUP BY t.doc_id),
{name} AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {name}_s QUALIFY rank <= {limit})"""


_BASE = f"words AS ({_WORDS}), lens AS (SELECT doc_id, len(w) AS dl FROM words), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)"
_BUCKET = "('0x' || substr(sha256(word), 1, 8))::BIGINT % 16"
_EMBED = f"""toks AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\s+')) AS word FROM documents),
cnt AS (SELECT doc_id, {_BUCKET} AS dim, count(*) AS c FROM toks WHERE word <> '' GROUP BY 1, 2),
norms AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM cnt GROUP BY doc_id)"""


def _fuse(*names: str) -> str:
    both = " UNION ALL ".join(f"SELECT doc_id, {i} AS list_no, rank FROM {n}" for i, n in enumerate(names))
    return f"""both_lists AS ({both}), fused AS (SELECT doc_id, sum(1::DOUBLE / (60 + rank) ORDER BY list_no) AS exact, min(list_no * 1000 + rank) AS first FROM both_lists GROUP BY doc_id),
top AS (SELECT doc_id, round(exact, 6) AS score, row_number() OVER (ORDER BY exact DESC, first) AS rank FROM fused QUALIFY rank <= 8)"""


_QVEC = "(SELECT dim, c FROM (SELECT " + _BUCKET + f" AS dim, count(*) AS c FROM (SELECT unnest(string_split('{QUERY}', ' ')) AS word) GROUP BY 1))"
_HYBRID = f"""WITH {_EMBED}, {_BASE},
vec_s AS (SELECT d.doc_id, coalesce(round(sum(cnt.c * q.c) / any_value(norm) / (SELECT sqrt(sum(c * c)) FROM {_QVEC} x), 6), 0) AS score FROM documents d LEFT JOIN norms ON norms.doc_id = d.doc_id LEFT JOIN cnt ON cnt.doc_id = d.doc_id LEFT JOIN {_QVEC} q ON q.dim = cnt.dim GROUP BY d.doc_id),
vec AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM vec_s QUALIFY rank <= 8),
{_bm25("kw", TERMS, 8)}, {_fuse("vec", "kw")}"""
_COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_UUID_HEX = "sha1(unhex('6BA7B8119DAD11D180B400C04FD430C8') || chunk_id::BLOB)"

_MAPPED = """SELECT CASE WHEN doc_id % 3 <> 0 THEN 'doc-' || (doc_id % 10) ELSE '' END AS document_id, CASE WHEN doc_id % 4 <> 0 THEN 'chunk-' || doc_id ELSE 'p-' || doc_id END AS chunk_id, CASE WHEN doc_id % 5 <> 0 THEN 'title' ELSE '' END AS title,
CASE WHEN doc_id % 2 = 0 THEN 'part' END AS section, CASE WHEN doc_id % 7 < 5 THEN doc_id % 7 ELSE -1 END AS page, length(coalesce(text, '')) AS n_chars, CASE WHEN doc_id % 6 <> 0 THEN doc_id / 8.0 ELSE 0 END::DOUBLE AS score, '{source}' AS source, doc_id AS rank FROM documents"""

ORACLES = {
    "token_count": f"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '{_NON_CJK}', '', 'g')) AS n_cjk, length(regexp_replace(coalesce(text, ''), '{_NON_CJK}', '', 'g')) + CAST(ceil((length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '{_NON_CJK}', '', 'g'))) / 4.0) AS BIGINT) AS n_tokens FROM documents",
    "chunk_identity": f"""WITH c AS (SELECT doc_id, text, doc_id || ':000001' AS chunk_id FROM documents), h AS (SELECT *, {_UUID_HEX} AS h FROM c)
SELECT doc_id, chunk_id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || lower(printf('%02x', (('0x' || substr(h,17,2))::INT & 63) | 128)) || substr(h,19,2) || '-' || substr(h,21,12) AS point_id, sha256(coalesce(text, '')) AS checksum FROM h""",
    "sentence_units": r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n\s*\n')) AS para, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), 1) AS pno FROM documents),
u AS (SELECT doc_id, pno, string_split(regexp_replace(regexp_replace(trim(para, E' \n\t\r'), '([。．])', E'\\1\x01', 'g'), '([.!?])(\s)', E'\\1\x01\\2', 'g'), E'\x01') AS l FROM p),
e AS (SELECT doc_id, pno, unnest(l) AS unit, generate_subscripts(l, 1) AS i FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pno, i) - 1 AS pos, unit FROM e WHERE trim(unit, E' \n\t\r') <> ''""",
    "hash_embed": f"WITH {_EMBED} SELECT d.doc_id, r.dim, round(coalesce(c / norm, 0), 6) AS x FROM documents d CROSS JOIN (SELECT unnest(range(16)) AS dim) r LEFT JOIN cnt ON cnt.doc_id = d.doc_id AND cnt.dim = r.dim LEFT JOIN norms ON norms.doc_id = d.doc_id",
    "vector_topk": f"SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0) QUALIFY rank <= 10",
    "vector_topk_multi": f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0) QUALIFY rank <= 10",
    "bm25_topk": f"WITH {_BASE}, {_bm25('kw', TERMS, 10)} SELECT * FROM kw",
    "rrf_fuse": f"WITH {_BASE}, {_bm25('ka', ('anon', 'tion'), 20)}, {_bm25('kb', ('ble', 'whou'), 20)}, {_fuse('ka', 'kb')} SELECT * FROM top",
    "hybrid_search": f"{_HYBRID} SELECT * FROM top",
    "citations": f"{_HYBRID} SELECT rank, doc_id, doc_id || ':000001' AS chunk_id, 'doc-' || doc_id AS title, score, sha256(coalesce(text, '')) AS checksum FROM top JOIN documents USING (doc_id)",
    "simple_answer": f"{_HYBRID} SELECT '{answers.HEADER}' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS answer FROM top JOIN documents USING (doc_id)",
    "rerank_merge": f"{_HYBRID}, api(pos, idx, s) AS (VALUES (0, 4, 0.9), (1, 2, 0.8), (5, 0, 0.4)) SELECT doc_id, coalesce(s, score)::DOUBLE AS score, row_number() OVER (ORDER BY pos IS NULL, pos, rank) AS rank, 'reranked' AS source FROM top LEFT JOIN api ON rank - 1 = idx QUALIFY row_number() OVER (ORDER BY pos IS NULL, pos, top.rank) <= 6",
    "rerank_overlap": f"{_HYBRID}, o AS (SELECT top.doc_id, top.rank AS old, len(list_distinct(list_filter(w, lambda x: x IN ('anon', 'tion', 'ble', 'whou')))) / 4.0 AS score FROM top JOIN words USING (doc_id)) SELECT doc_id, score::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, old) AS rank, 'reranked' AS source FROM o QUALIFY rank <= 5",
    "list_documents": "SELECT CAST(doc_id AS VARCHAR) AS id, 'doc-' || doc_id AS title, 'doc-' || doc_id || '.md' AS original_filename, 'text/markdown' AS mime_type, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'processing' ELSE 'ready' END AS status, 1 AS version, strftime(TIMESTAMP '1970-01-01' + to_seconds(doc_id * 60), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(TIMESTAMP '1970-01-01' + to_seconds(doc_id * 60 + 5), '%Y-%m-%d %H:%M:%S') AS updated_at FROM documents",
    "ready_counts": "SELECT count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 5 <> 0) AS ready, count(*) AS total FROM documents",
    "upsert_latest": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN n_chars + 7 WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents UNION ALL SELECT doc_id + 1000000000, n_chars FROM documents WHERE doc_id % 6 = 0",
    "bucket_commits": """WITH gone AS (SELECT doc_id FROM documents WHERE length(text) % 7 = 0)
SELECT 'documents' AS table_name, doc_id, CAST(-1 AS BIGINT) AS turn, md5(CASE WHEN length(text) % 10 = 3 THEN 'again ' || text ELSE text END) AS digest
FROM documents WHERE doc_id NOT IN (FROM gone)
UNION ALL
SELECT 'turns', conv_id, turn, md5(max(text)) FROM conversations WHERE conv_id NOT IN (FROM gone) GROUP BY conv_id, turn""",
    "cascade_delete": "SELECT 'documents' AS table_name, count(*) AS rows_left FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT 'chunks', count(*) FROM conversations WHERE NOT (conv_id % 10 = 3 AND conv_id IN (SELECT doc_id FROM documents))",
    "job_state": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "classify_upload": """SELECT doc_id, CASE WHEN doc_id % 6 <= 2 OR doc_id % 4 = 0 THEN 'direct' WHEN doc_id % 6 = 3 OR doc_id % 4 = 1 THEN 'pdf' END AS kind, 'doc-' || doc_id AS title FROM documents""",
    "health": """SELECT 'ok' AS status, '{"documents":true,"embeddings":true}' AS stores""",
    "vector_hits": _MAPPED.format(source="vector"),
    "keyword_hits": _MAPPED.format(source="keyword"),
    "payload_filter": "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 10 = 4",
    "term_filter": "SELECT doc_id FROM documents WHERE doc_id % 2 = 0",
    "render_citation": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'part' ELSE 'Untitled section' END || CASE WHEN doc_id % 7 BETWEEN 1 AND 4 THEN ', page ' || (doc_id % 7) ELSE '' END AS shown FROM documents",
    "prompt_messages": f"""{_HYBRID} SELECT 'system' AS role, '{answers.SYSTEM_PROMPT.replace("'", "''")}' AS content
UNION ALL SELECT 'user', 'Context:' || chr(10) || string_agg('[' || rank || '] (chunk_id=' || doc_id || ':000001) ' || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: {QUERY}' FROM top JOIN documents USING (doc_id)""",
    "poll_state": "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ready' END AS status FROM documents WHERE doc_id IN (1, 7)",
    "job_log": """SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 7 = 0 THEN least(1000, length(coalesce(text, 'no text'))) ELSE 0 END AS reason_chars,
sha256(doc_id || ':s0') AS id, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ready' END AS document_status FROM documents""",
    "index_search": f"WITH {_BASE}, {_bm25('kw', TERMS, 10)} SELECT * FROM kw",
    "width_fold": "SELECT doc_id, sha256(coalesce(text, '')) AS folded_sha256 FROM documents",
    "pdf_reading_order": """WITH b AS (SELECT doc_id - doc_id % 50 AS d, doc_id % 50 // 5 + 1 AS page, doc_id % 2 AS col, doc_id % 5 AS y, doc_id, CASE WHEN doc_id % 10 = 3 THEN '# ' ELSE '' END || 'block ' || doc_id || ' has some words' AS t FROM documents),
c AS (SELECT *, CASE WHEN count(DISTINCT col) OVER (PARTITION BY d, page) = 2 THEN col ELSE 0 END AS side FROM b),
p AS (SELECT d, page, '<!-- page: ' || page || ' -->' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY side, y, doc_id) AS t FROM c GROUP BY d, page)
SELECT CAST(d AS VARCHAR) AS document_id, string_agg(t, chr(10) || chr(10) ORDER BY page) AS markdown FROM p GROUP BY d""",
    "sse_frames": f"""{_HYBRID}, cited AS (SELECT top.*, text FROM top JOIN documents USING (doc_id)),
body AS (SELECT string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS t FROM cited)
SELECT 0 AS seq, 'citations' AS event, '[' || string_agg('{{"chunk_id":"' || doc_id || ':000001","title":"doc-' || doc_id || '","score":' || score || '}}', ',' ORDER BY rank) || ']' AS data FROM cited
UNION ALL SELECT 1, 'delta', '{{"content":' || to_json('{answers.HEADER}' || chr(10) || chr(10))::VARCHAR || '}}'
UNION ALL SELECT 2, 'delta', '{{"content":' || to_json(t)::VARCHAR || '}}' FROM body
UNION ALL SELECT 99, 'done', '{{}}'""",
}
#: With all cells probed the stored index gives what a full scan gives.
ORACLES["vector_index_topk"] = ORACLES["vector_topk_multi"]
_SPACES = r"E' \n\t\r'"
_TOKENS = "length(regexp_replace({0}, '{1}', '', 'g')) + CAST(ceil((length({0}) - length(regexp_replace({0}, '{1}', '', 'g'))) / 4.0) AS BIGINT)"
#: Where a window may be cut: after the last of each break that begins in its second half, else where the window ends.
_CUT = "greatest(" + ", ".join(f"CASE WHEN instr(reverse(w), '{b[::-1]}') > 0 AND length(w) - instr(reverse(w), '{b[::-1]}') - {len(b) - 1} >= length(w) // 2 THEN length(w) - instr(reverse(w), '{b[::-1]}') + 1 ELSE 0 END" for b in chunking.BREAKS) + ")"
#: The driver's texts are one paragraph each; units over the budget hold no CJK character, so a window is 4 * 512 long.
ORACLES["pack_chunks"] = rf"""WITH RECURSIVE d AS (SELECT doc_id, rtrim(regexp_replace(coalesce(text, ''), '^([ \t\r]*\n)+', ''), {_SPACES}) AS src FROM documents WHERE trim(coalesce(text, ''), {_SPACES}) <> ''),
t AS (SELECT doc_id, src, {_TOKENS.format("src", _NON_CJK)} AS n FROM d),
p AS (SELECT doc_id, unnest(regexp_split_to_array(src, '\n\s*\n')) AS para, generate_subscripts(regexp_split_to_array(src, '\n\s*\n'), 1) AS pno FROM t WHERE n > 512),
l AS (SELECT doc_id, pno, string_split(regexp_replace(regexp_replace(trim(para, {_SPACES}), '([。．])', E'\\1\x01', 'g'), '([.!?])(\s)', E'\\1\x01\\2', 'g'), E'\x01') AS l FROM p),
e AS (SELECT doc_id, pno, unnest(l) AS unit, generate_subscripts(l, 1) AS i FROM l),
u AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pno, i) AS pos, unit, {_TOKENS.format("unit", _NON_CJK)} AS n FROM e WHERE trim(unit, {_SPACES}) <> ''),
fold(doc_id, pos, grp, held) AS (SELECT doc_id, pos, 1, CASE WHEN n > 512 THEN 513 ELSE n END FROM u WHERE pos = 1
  UNION ALL SELECT u.doc_id, u.pos, grp + (held + u.n > 512)::INT, CASE WHEN u.n > 512 THEN 513 WHEN held + u.n > 512 THEN u.n ELSE held + u.n END FROM fold f JOIN u ON u.doc_id = f.doc_id AND u.pos = f.pos + 1),
win(doc_id, grp, unit, w, start, turn) AS (SELECT doc_id, grp, unit, substr(unit, 1, 2048), 0, 1 FROM fold JOIN u USING (doc_id, pos) WHERE n > 512
  UNION ALL SELECT doc_id, grp, unit, substr(unit, next + 1, 2048), next, turn + 1
  FROM (SELECT *, greatest(start + CASE WHEN {_CUT} > 0 THEN {_CUT} ELSE length(w) END - 256, start + 1) AS next FROM win WHERE start + length(w) < length(unit))),
cut AS (SELECT doc_id, grp, turn, CASE WHEN start + length(w) < length(unit) AND {_CUT} > 0 THEN left(w, {_CUT}) ELSE w END AS text FROM win),
made AS (SELECT doc_id, 0 AS grp, 1 AS turn, trim(src, {_SPACES}) AS text FROM t WHERE n <= 512
  UNION ALL SELECT doc_id, grp, 1, trim(string_agg(unit, '' ORDER BY pos), {_SPACES}) FROM fold JOIN u USING (doc_id, pos) WHERE n <= 512 GROUP BY 1, 2
  UNION ALL SELECT * FROM cut WHERE trim(text, {_SPACES}) <> ''),
c AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY grp, turn)::INTEGER AS chunk_index FROM made),
i AS (SELECT *, doc_id || ':' || printf('%06d', chunk_index) AS chunk_id FROM c), h AS (SELECT *, {_UUID_HEX} AS h FROM i)
SELECT CAST(doc_id AS VARCHAR) AS document_id, '' AS title, chunk_index, NULL::VARCHAR AS section, NULL::INTEGER AS page, chunk_id, ({_TOKENS.format("text", _NON_CJK)})::INTEGER AS token_count, sha256(text) AS checksum,
substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || lower(printf('%02x', (('0x' || substr(h,17,2))::INT & 63) | 128)) || substr(h,19,2) || '-' || substr(h,21,12) AS vector_point_id, chunk_id AS keyword_document_id FROM h"""
