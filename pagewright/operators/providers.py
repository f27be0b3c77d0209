"""Model inference behind one interface each: embeddings, rerankers, and the HTTP calls of services.

Providers are plain objects that travel to executors with the plan. A local model is loaded there once for each Python
worker's task, by the function that the caller gives. Documents are embedded where they lie; a reranker sees the few
fused hits of one query.
"""

from __future__ import annotations

import json
import sys
import types
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pagewright.operators import answers, search

EMBED_BATCH, RERANK_BATCH = 64, 8
#: Tokens of a pair that a cross-encoder reads at most.
MAX_LENGTH = 512
EMBED_TIMEOUT, RERANK_TIMEOUT = 30.0, 30.0
INSTRUCTION = "Rank the document based on its relevance to the query."  # fixed value


def _request(url: str, key: str, body: dict) -> urllib.request.Request:
    return urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})


def post_json(url: str, key: str, body: dict, timeout: float) -> dict:
    with urllib.request.urlopen(_request(url, key, body), timeout=timeout) as got:
        return json.load(got)


def post_lines(url: str, key: str, body: dict, timeout: float) -> Iterator[str]:
    with urllib.request.urlopen(_request(url, key, body), timeout=timeout) as got:
        for line in got:
            yield line.decode("utf-8", "replace").rstrip("\r\n")


def require(**values: str | None) -> None:
    if missing := [name for name, value in values.items() if not value]:
        raise ValueError(f"{', '.join(missing)} required")


def normalised(vectors) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    v = np.asarray(vectors, np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True) if v.size else np.ones((len(v), 1))
    return v / np.where(norm == 0, 1, norm)


def held(name: str, load: Callable):
    """What ``load`` gives, loaded once in each Python worker however many tasks and plans ask for it: functions travel by
    value and take no globals along, so the store is a module of the worker's own."""
    store = sys.modules.setdefault("pagewright_models", types.ModuleType("pagewright_models"))
    if name not in vars(store):
        setattr(store, name, load())
    return getattr(store, name)


class HashEmbedding:
    """Token counts by hash bucket; no model and no Python on executors."""

    def __init__(self, dimensions: int = search.HASH_DIMS):
        self.dimensions = dimensions

    def vectors(self, rows: DataFrame, key: str, text) -> DataFrame:
        return search.hash_embedding(rows, key, text, self.dimensions)


class _BatchEmbedding:
    def embedder(self) -> Callable[[list[str]], np.ndarray]:
        """Called once in each task."""
        raise NotImplementedError

    def vectors(self, rows: DataFrame, key: str, text) -> DataFrame:
        """(key, vector) of length one, in batches of EMBED_BATCH; null texts count as empty. Errors end the job."""
        source = rows.select(F.col(key).alias(key), F.coalesce(text, F.lit("")).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            embed = self.embedder()
            for batch in batches:
                for at in range(0, batch.num_rows, EMBED_BATCH):
                    part = batch.slice(at, EMBED_BATCH)
                    found = normalised(embed(part.column(1).to_pylist()))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.tolist(), pa.list_(pa.float64()))], names=[key, "vector"])

        return source.mapInArrow(run, source.select(key).schema.add("vector", ArrayType(DoubleType())))


class LocalEmbedding(_BatchEmbedding):
    """``load`` gives a function from texts to vectors, and is called once in each Python worker. Without ``dimensions``
    they are asked of the model, by one text, when they are first needed."""

    def __init__(self, load: Callable[[], Callable[[list[str]], object]], dimensions: int | None = None):
        self.load, self._dimensions, self.name = load, dimensions, uuid.uuid4().hex

    @property
    def dimensions(self) -> int:
        if self._dimensions is None:
            self._dimensions = len(np.asarray(self.embedder()([""]))[0])
        return self._dimensions

    def embedder(self):
        return held(self.name, self.load)


class ServiceEmbedding(_BatchEmbedding):
    """A service with the common ``/embeddings`` interface."""

    def __init__(self, base_url: str | None, api_key: str | None, model: str | None, dimensions: int, timeout: float = EMBED_TIMEOUT, transport: Callable = post_json):
        require(base_url=base_url, api_key=api_key, model=model)
        self.base_url, self.api_key, self.model = base_url.rstrip("/"), api_key, model
        self.dimensions, self.timeout, self.transport = dimensions, timeout, transport

    def embedder(self):
        def embed(texts: list[str]) -> list[list[float]]:
            got = self.transport(f"{self.base_url}/embeddings", self.api_key, {"input": texts, "model": self.model}, self.timeout)
            return [x["embedding"] for x in got["data"]]

        return embed


class CrossEncoder:
    """A model that gives a (no, yes) pair of logits for each prompt, RERANK_BATCH prompts at a time.

    ``score`` takes prompts and travels with the plan; a large model comes by ``load`` instead, which is called once in
    each Python worker and gives a function of (prompts, max_length), whose tokenizer cuts at that many tokens.
    """

    def __init__(self, score: Callable[[list[str]], object] | None = None, instruction: str = INSTRUCTION, load: Callable | None = None, max_length: int = MAX_LENGTH):
        if (score is None) == (load is None):
            raise ValueError("one of score and load is needed")
        self.score, self.instruction, self.load, self.max_length, self.name = score, instruction, load, max_length, uuid.uuid4().hex

    def _logits(self, prompts: list[str]) -> np.ndarray:
        found = self.score(prompts) if self.load is None else held(self.name, self.load)(prompts, self.max_length)
        return np.asarray(found, np.float64).reshape(-1, 2)

    def _scored(self, asked: DataFrame) -> DataFrame:
        """Rows that end in a prompt -> their other columns and the probability of yes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, RERANK_BATCH):
                    part = batch.slice(at, RERANK_BATCH)
                    logit = self._logits(part.column(part.num_columns - 1).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(logit[:, 0] - logit[:, 1])))], names=[*part.schema.names[:-1], "yes"])

        return asked.mapInArrow(run, asked.drop("prompt").schema.add("yes", "double"))

    def rerank(self, hits: DataFrame, query: str, limit: int) -> DataFrame:
        """Hits by the probability of yes, descending and stable, with source 'reranked'."""
        asked = hits.select("rank", answers.rerank_prompt(self.instruction, F.lit(query), F.col("text")).alias("prompt"))
        joined = hits.join(F.broadcast(self._scored(asked)), "rank")
        return answers.rerank(joined, lambda q, text: F.col("yes"), query, limit).drop("yes")

    def rerank_many(self, hits: DataFrame, limit: int) -> DataFrame:
        """The hits of many queries (query_id, query, rank, text and others), reranked in one plan: query by query as
        ``rerank`` would. Pairs are dealt to all tasks, not by query, and sorted by length there, so that a batch pads
        little and no query's many or long hits hold up one task. ``rank`` tells a query's hits apart."""
        prompt = answers.rerank_prompt(self.instruction, F.col("query"), F.col("text"))
        asked = hits.select("query_id", "rank", prompt.alias("prompt")).repartition("query_id", "rank")
        scored = self._scored(asked.sortWithinPartitions(F.length("prompt"), "query_id", "rank"))
        order = Window.partitionBy("query_id").orderBy(F.desc("yes"), F.col("rank"))
        top = hits.join(scored, ["query_id", "rank"]).withColumn("_turn", F.row_number().over(order)).filter(F.col("_turn") <= limit)
        return top.withColumns({"score": F.col("yes"), "rank": F.col("_turn"), "source": F.lit("reranked")}).drop("yes", "_turn")


class ServiceReranker:
    """A service with a ``/reranks`` interface, asked once for each query with its few hits."""

    def __init__(self, base_url: str | None, api_key: str | None, model: str | None, instruction: str = INSTRUCTION, timeout: float = RERANK_TIMEOUT, transport: Callable = post_json):
        require(base_url=base_url, api_key=api_key, model=model)
        self.base_url, self.api_key, self.model = base_url.rstrip("/"), api_key, model
        self.instruction, self.timeout, self.transport = instruction, timeout, transport

    def rerank(self, hits: DataFrame, query: str, limit: int) -> DataFrame:
        """Hits in the service's order, those it leaves out behind. Where it fails in any way the hits stay as they are."""
        texts = [r["text"] for r in hits.select("rank", "text").orderBy("rank").limit(search.MAX_FETCH).collect()]
        if not texts:
            return hits
        body = {"model": self.model, "query": query, "documents": texts, "top_n": limit, "instruct": self.instruction}
        try:
            got = self.transport(f"{self.base_url}/reranks", self.api_key, body, self.timeout)
            rows = [(i, x.get("index"), float(x.get("relevance_score", x.get("score", 0.0)))) for i, x in enumerate(got.get("results") or got.get("data") or [])]
        except Exception:  # noqa: BLE001  a search goes on without its reranker
            return hits.orderBy("rank").limit(limit)
        result = hits.sparkSession.createDataFrame(rows, "pos int, index int, relevance_score double")
        return answers.merge_rerank_result(hits, result, limit)
