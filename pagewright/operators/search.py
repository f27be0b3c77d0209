"""Vector and keyword top-k, reciprocal rank fusion and citations."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from pagewright.functions import scalars

K1, B = 1.2, 0.75
RRF_K = 60
LIMIT, MAX_LIMIT = 8, 30
#: Hits that a reranker may be given.
MAX_FETCH = 1000
HASH_DIMS = 16
#: Queries that are scored in one pass.
QUERY_BLOCK = 4096
#: Stop words of the keyword analysis (fixed values).
STOP_WORDS = ("a", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "s", "such", "t", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with", "www")
_CJK_LETTER = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"


#: Full-width ASCII and half-width kana, folded to the usual width as Unicode's compatibility forms say.
_WIDE = "".join(chr(c) for c in (*range(0xFF01, 0xFF5F), *range(0xFF65, 0xFFA0)))
_FOLDED = "".join({"\uff9e": "\u3099", "\uff9f": "\u309a"}.get(c) or unicodedata.normalize("NFKC", c) for c in _WIDE)
_VOICED = [(kana + mark, unicodedata.normalize("NFC", kana + mark)) for mark in "\u3099\u309a" for kana in sorted(set(_FOLDED)) if len(unicodedata.normalize("NFC", kana + mark)) == 1]


def fold_width(text: Column) -> Column:
    """Full-width letters, digits and signs as ASCII, half-width kana as full-width ones with their voice marks joined."""
    plain = F.translate(text, _WIDE, _FOLDED)
    joined = plain
    for apart, whole in _VOICED:
        joined = F.replace(joined, F.lit(apart), F.lit(whole))
    return F.when(plain.rlike("[\u3099\u309a]"), joined).otherwise(plain)


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    return limit


def keyword_tokens(text: Column) -> Column:
    """Terms of a text: runs of letters and digits lower-cased, runs of CJK letters as overlapping pairs (a single one
    as itself), without stop words."""
    text = F.coalesce(text, F.lit(""))
    text = F.lower(F.when(text.rlike(f"[{_WIDE[0]}-{_WIDE[-1]}]"), fold_width(text)).otherwise(text))
    plain = F.split(text, r"[^\p{L}\p{M}\p{N}]+")
    cut = F.split(text, rf"[^\p{{L}}\p{{M}}\p{{N}}]+|(?<=[{_CJK_LETTER}])(?![{_CJK_LETTER}])|(?<![{_CJK_LETTER}])(?=[{_CJK_LETTER}])")
    pairs = lambda r: F.when(r.rlike(f"^[{_CJK_LETTER}]") & (F.length(r) > 1), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r))
    terms = F.when(text.rlike(f"[{_CJK_LETTER}]"), F.flatten(F.transform(cut, pairs))).otherwise(plain)
    return F.filter(terms, lambda w: ~w.isin("", *STOP_WORDS))


def hash_embedding(rows: DataFrame, key: str, text: Column, dims: int = HASH_DIMS) -> DataFrame:
    """(key, vector): counts of tokens by bucket (the first four bytes of their sha256), L2-normalised. Texts without
    tokens get a zero vector."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    words = rows.select(F.col(key), F.explode_outer(tokens).alias("word"))
    bucket = F.conv(F.substring(F.sha2("word", 256), 1, 8), 16, 10).cast("bigint") % dims
    counted = words.withColumn("bucket", bucket).groupBy(key).agg(*[F.count_if(F.col("bucket") == i).cast("double").alias(f"b{i}") for i in range(dims)])
    return counted.select(key, scalars.l2_normalise(F.array(*[f"b{i}" for i in range(dims)])).alias("vector"))


def vector_topk(vectors: DataFrame, query: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, score, rank) of the nearest vectors to the one row of ``query`` (column ``query_vector``), by cosine rounded
    to six decimals, then key. The query is a single row, so it is broadcast. Rows without key or vector are no
    candidates, and a query without a vector has no hits; so too for many queries."""
    vectors, query = vectors.filter(F.col(key).isNotNull() & F.col("vector").isNotNull()), query.filter("query_vector is not null")
    scored = vectors.join(F.broadcast(query.limit(1)), F.lit(True)).select(key, F.round(scalars.cosine(F.col("vector"), F.col("query_vector")), 6).alias("score"))
    return ranked(scored, key, limit)


def ranked(scored: DataFrame, key: str, limit: int) -> DataFrame:
    top = scored.orderBy(F.desc("score"), F.col(key)).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col(key))))


def _sortable(column: pa.Array) -> np.ndarray:
    """Keys as an array that numpy sorts in Spark's order."""
    values = column.to_numpy(zero_copy_only=False)
    return values.astype("U") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else values


def block_best(held, limit: int, schema: pa.Schema):
    """A function of batches (key, vector, and cell where queries name cells) that keeps a task's best ``limit`` keys for
    each query of a broadcast block: ids, vectors, and None or for each query the cells it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, cells = held.value
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def take(asked: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> None:
            scores = np.round(q[asked] @ (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)).T, 6)
            if len(keys) > limit:  # all that may be among the best, ties with the last included
                least = np.partition(scores, len(keys) - limit, axis=1)[:, len(keys) - limit]
            else:
                least = np.full(len(asked), -np.inf)
            for row, at in enumerate(asked.tolist()):
                near = np.flatnonzero(scores[row] >= least[row])
                s, k = scores[row][near], keys[near]
                if at in best:
                    s, k = np.concatenate([best[at][0], s]), np.concatenate([best[at][1], k])
                order = np.lexsort((k, -s))[:limit]
                best[at] = s[order], k[order]

        everyone = np.arange(len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                keys = _sortable(part.column(0))
                if cells is None:
                    take(everyone, keys, vectors)
                    continue
                own = part.column(2).to_numpy()
                for cell in np.unique(own).tolist():
                    if len(asked := np.flatnonzero((cells == cell).any(axis=1))):
                        take(asked, keys[own == cell], vectors[own == cell])
        for at, (s, k) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([ids[at]] * len(s), schema.field(0).type), pa.array(k.tolist(), schema.field(1).type), pa.array(s)], schema=schema)

    return run


def best_of_queries(queries: DataFrame, key: str, key_type: DataType, limit: int, found: Callable, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score, rank) for queries (query_id of any type, query_vector), taken in blocks of a bounded size:
    ``found(rows, score)`` gives what a block's rows (id, vector) find, where ``score(cells)`` makes the function for
    ``mapInArrow`` and its schema."""
    spark = queries.sparkSession
    queries = queries.select("query_id", "query_vector").filter("query_id is not null and query_vector is not null")
    fields = StructType([StructField("query_id", queries.schema[0].dataType), StructField(key, key_type), StructField("score", DoubleType())])
    schema, parts, rows = to_arrow_schema(fields), [], []

    def send() -> None:
        ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
        score = lambda cells=None: (block_best(spark.sparkContext.broadcast((ids, vectors, cells)), limit, schema), fields)
        parts.append(found(vectors, score))

    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            send()
            rows = []
    if rows:
        send()
    if not parts:
        return spark.createDataFrame([], fields).withColumn("rank", F.lit(0))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(key))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def vector_topk_multi(vectors: DataFrame, queries: DataFrame, key: str, limit: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score, rank) for many queries (query_id, query_vector) against all vectors; keys are whole numbers
    or strings.

    Queries go out in blocks of a bounded size. Each task multiplies its vectors with the block and keeps its own best
    ``limit`` of each query, so that tasks x queries x limit rows are exchanged.
    """
    source = vectors.select(key, "vector").filter(F.col(key).isNotNull() & F.col("vector").isNotNull())
    return best_of_queries(queries, key, vectors.schema[key].dataType, limit, lambda _, score: source.mapInArrow(*score()), block)


def text_postings(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, dl) of each text by itself, counted where it lies: its terms are sorted and their runs measured."""
    first = lambda ts: F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i) != F.get(ts, i - 1)))
    ends = lambda ts, at: F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(ts)))
    runs = lambda ts, at: F.zip_with(at, ends(ts, at), lambda lo, hi: F.struct(F.get(ts, lo).alias("term"), (hi - lo).cast("long").alias("tf"), F.size(ts).alias("dl")))
    # arrays of one element, so that tokens and places are made once a text
    made = F.transform(F.array(F.sort_array(keyword_tokens(text))), lambda ts: F.when(F.size(ts) > 0, F.flatten(F.transform(F.array(first(ts)), lambda at: runs(ts, at)))))
    return rows.select(F.col(key), F.inline(made[0]))


def postings(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, dl) of all texts, those of a repeated key together. Write it once, by term, to search it often."""
    return merged_postings(text_postings(rows, key, text), key)


def merged_postings(rows: DataFrame, key: str, *also: str) -> DataFrame:
    return rows.groupBy(key, "term", *also).agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def bm25_topk(rows: DataFrame, key: str, text: Column, query: str, limit: int) -> DataFrame:
    """(key, score, rank) of the best texts for a query by BM25, with raw lengths and idf ln(1 + (N - df + 0.5) / (df +
    0.5)). Texts are counted where they lie: only rows that hold a query term leave the scan."""
    spark = rows.sparkSession
    terms = [x[0] for x in spark.range(1).select(F.explode(keyword_tokens(F.lit(query)))).distinct().collect()]
    if not terms:
        return ranked(rows.select(key, F.lit(0.0).alias("score")).filter("false"), key, limit)
    tokens = keyword_tokens(text)
    times = lambda ts, t: F.size(F.filter(ts, lambda w: w == t))
    # one generated row a text, so that the tokens are cut once and not again in each count
    counts = F.transform(F.array(tokens), lambda ts: F.struct(F.size(ts).alias("dl"), *[times(ts, t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    counted = rows.select(F.col(key), F.inline(counts))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats), F.lit(True))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return ranked(joined.select(key, F.round(score, 6).alias("score")), key, limit)


def rrf_fuse(lists: list[DataFrame], key: str, k: int = RRF_K, limit: int = LIMIT) -> DataFrame:
    """(key, score, rank) by the sum of 1 / (k + rank) over the lists; ties keep the order in which they were first seen."""
    if not lists:
        return SparkSession.active().createDataFrame([], f"{key} string, score double, rank int")
    both = None
    for i, ranked_list in enumerate(lists):
        part = ranked_list.select(key, F.lit(i).alias("list_no"), "rank")
        both = part if both is None else both.unionByName(part)
    # summed list by list, so that equal ranks give equal sums at every partitioning; only what is shown is rounded
    places = F.array_sort(F.collect_list(F.struct("list_no", "rank")))
    exact = F.aggregate(places, F.lit(0.0), lambda total, p: total + 1.0 / (k + p["rank"]))
    fused = both.groupBy(key).agg(exact.alias("exact"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = (F.desc("exact"), F.col("first.list_no"), F.col("first.rank"))
    top = fused.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.select(key, F.round("exact", 6).alias("score"), "rank")


def fetch_size(limit: int, rerank_top_k: int | None) -> int:
    """What each list gives: more than the limit where a reranker follows."""
    return max(limit, rerank_top_k) if rerank_top_k else limit


def hybrid_search(rows: DataFrame, key: str, text: Column, query: str, limit: int = LIMIT, rerank_top_k: int | None = None, dims: int = HASH_DIMS) -> DataFrame:
    """(key, score, rank) of the fused vector and keyword lists. Texts are joined back to the few rows that remain."""
    check_limit(limit)
    fetch = fetch_size(limit, rerank_top_k)
    vectors = hash_embedding(rows, key, text, dims)
    asked = hash_embedding(rows.sparkSession.range(1).select(F.col("id").alias("qid"), F.lit(query).alias("q")), "qid", F.col("q"), dims).select(F.col("vector").alias("query_vector"))
    return rrf_fuse([vector_topk(vectors, asked, key, fetch), bm25_topk(rows, key, text, query, fetch)], key, RRF_K, fetch)


def citations(hits: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """The hits with their payload columns, in rank order."""
    return payload.join(F.broadcast(hits.limit(MAX_FETCH)), key).orderBy("rank")


HIT = ("document_id", "chunk_id", "title", "section", "page", "text")


def _hits(fields: Column, own_id: Column, score: Column, source: str) -> list[Column]:
    text = lambda c: F.coalesce(fields[c], F.lit(""))
    return [text("docId").alias("document_id"), F.coalesce(fields["chunkId"], own_id.cast("string")).alias("chunk_id"), text("title").alias("title"), fields["section"].alias("section"), fields["page"].alias("page"), text("text").alias("text"), F.coalesce(score, F.lit(0.0)).cast("double").alias("score"), F.lit(source).alias("source")]


def vector_hits(points: DataFrame) -> DataFrame:
    """Hits of (point_id, payload, score, rank): missing texts are empty, a missing chunk id is the point's."""
    return points.select(*_hits(F.col("payload"), F.col("point_id"), F.col("score"), "vector"), "rank")


def keyword_hits(found: DataFrame) -> DataFrame:
    """Hits of (_id, document, score, rank), with the same defaults."""
    return found.select(*_hits(F.col("document"), F.col("_id"), F.col("score"), "keyword"), "rank")


def fuse_hits(lists: list[DataFrame], k: int = RRF_K, limit: int = LIMIT) -> DataFrame:
    """The fused list of whole hits, with source 'rrf': each chunk's fields are those of the first list that holds it."""
    fused = rrf_fuse(lists, "chunk_id", k, limit)
    if not lists:
        return fused
    every = None
    for i, hits in enumerate(lists):
        part = hits.select("chunk_id", F.struct(F.lit(i).alias("i"), *[c for c in HIT if c != "chunk_id"]).alias("hit"))
        every = part if every is None else every.unionByName(part)
    fields = every.groupBy("chunk_id").agg(F.min_by("hit", F.col("hit.i")).alias("hit"))
    whole = fields.join(F.broadcast(fused.limit(MAX_FETCH)), "chunk_id")
    return whole.select("hit.document_id", "chunk_id", *[F.col(f"hit.{c}").alias(c) for c in HIT[2:]], "score", "rank", F.lit("rrf").alias("source"))


class Retriever:
    """Hybrid search with what is given: ``vectors(query_vector frame, limit)`` and ``keywords(query, limit)`` return hits,
    ``embedding`` has ``vectors(rows, key, text)``, ``reranker`` has ``rerank(hits, query, limit)`` or is None."""

    def __init__(self, vectors: Callable[[DataFrame, int], DataFrame], keywords: Callable[[str, int], DataFrame], embedding, reranker=None, rrf_k: int = RRF_K, rerank_top_k: int = 20):
        self.vectors, self.keywords, self.embedding, self.reranker = vectors, keywords, embedding, reranker
        self.rrf_k, self.rerank_top_k = rrf_k, rerank_top_k

    def search(self, spark: SparkSession, query: str, limit: int = LIMIT) -> DataFrame:
        check_limit(limit)
        fetch = fetch_size(limit, self.rerank_top_k if self.reranker else None)
        asked = self.embedding.vectors(spark.range(1).select("id", F.lit(query).alias("text")), "id", F.col("text")).select(F.col("vector").alias("query_vector"))
        fused = fuse_hits([self.vectors(asked, fetch), self.keywords(query, fetch)], self.rrf_k, fetch)
        return self.reranker.rerank(fused, query, limit) if self.reranker else fused


#: Folders that postings are dealt to by term, so that a query reads those of its terms alone.
TERM_BUCKETS = 256


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def write_postings(rows: DataFrame, key: str, text: Column, path: str) -> None:
    """Stores postings by term, and the lengths of all texts, for ``stored_bm25``. Texts are counted where they lie, so
    that postings move once, to their folder; those of a repeated key are added up where they are read."""
    counted = text_postings(rows, key, text)
    counted.repartition(_bucket(F.col("term"))).withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    rows.select(F.size(keyword_tokens(text)).cast("long").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).write.mode("overwrite").parquet(f"{path}/lengths")


def read_postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The postings of some terms: only their folders are listed in the plan, and only their row groups are read."""
    buckets = [r[0] for r in spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t")).select(_bucket(F.col("t"))).distinct().collect()]
    found = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    return merged_postings(found, next(c for c in found.columns if c not in ("term", "tf", "dl", "bucket")), "bucket")


def stored_bm25(spark: SparkSession, path: str, key: str, query: str, limit: int) -> DataFrame:
    """``bm25_topk`` over stored postings: (key, score, rank)."""
    terms = [x[0] for x in spark.range(1).select(F.explode(keyword_tokens(F.lit(query)))).distinct().collect()]
    lengths = spark.read.parquet(f"{path}/lengths").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
    return score_with(read_postings(spark, path, terms or [""]), lengths, key, limit)


def score_postings(found: DataFrame, every: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, score, rank) from the postings of the query's terms and all postings (key, term, tf, dl), for the lengths."""
    lengths = every.groupBy(key).agg(F.max("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return score_with(found, lengths, key, limit)


def score_with(found: DataFrame, lengths: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, score, rank) from the postings of the query's terms and one row of n texts and their mean length avgdl."""
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.join(F.broadcast(df), "term").join(F.broadcast(lengths), F.lit(True)).groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(scored, key, limit)


def health(stores: DataFrame) -> DataFrame:
    """One row of (status, stores) from (store, healthy) rows: ok where all are healthy, else degraded."""
    return stores.agg(F.when(F.coalesce(F.bool_and("healthy"), F.lit(True)), "ok").otherwise("degraded").alias("status"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("store", "healthy")))).alias("stores"))


