"""The retrieval engine that settings describe: ingestion, search, answers and deletes over one folder of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import providers
from pagewright.operators.search import LIMIT, Retriever
from pagewright.plans.settings import Settings, make_answers, make_embedding, make_reranker
from pagewright.streaming import ingest


@dataclass
class Engine:
    """``index_path`` of the settings holds the tables. Building one connects to nothing and loads no model."""

    spark: SparkSession
    settings: Settings
    embedding: object
    reranker: object | None
    answers: object

    def ingest(self, path: str, pages: DataFrame | None = None) -> None:
        """The files of a folder, or a file, now."""
        ingest.ingest_files(self.spark, path, self.settings.index_path, pages, self.embedding)

    def watch(self, path: str, checkpoint: str, pages: DataFrame | None = None) -> StreamingQuery:
        """The new files of a folder as a stream."""
        return ingest.ingest_stream(self.spark, path, self.settings.index_path, checkpoint, pages, self.embedding)

    def retriever(self) -> Retriever:
        return ingest.retriever(self.spark, self.settings.index_path, self.embedding, self.reranker, self.settings.rrf_k, self.settings.rerank_top_k)

    def search(self, query: str, limit: int = LIMIT) -> DataFrame:
        return self.retriever().search(self.spark, query, limit)

    def answer(self, query: str, limit: int = LIMIT) -> str:
        return self.answers.answer(self.search(query, limit), query)

    def stream(self, query: str, limit: int = LIMIT) -> Iterator[str]:
        return self.answers.stream(self.search(query, limit), query)

    def documents(self) -> DataFrame:
        return ingest.current_documents(self.spark, self.settings.index_path)

    def delete(self, document_id: str) -> bool:
        return ingest.delete_document(self.spark, self.settings.index_path, document_id)


def build_engine(spark: SparkSession, settings: Settings | None = None, load_embedding: Callable | None = None, load_reranker: Callable | None = None, transport: Callable = providers.post_json, lines: Callable = providers.post_lines) -> Engine:
    """The engine of the settings, by default those of the environment. Local models come by the functions given; without
    them texts are embedded by hash and hits are not reranked."""
    settings = settings or Settings.load()
    embedding = make_embedding(settings, load_embedding, transport)
    return Engine(spark, settings, embedding, make_reranker(settings, transport=transport, load=load_reranker), make_answers(settings, transport, lines))
