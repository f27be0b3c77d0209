"""Reranking, answers and event streams over ranked hits (rank, chunk_id, title, section, page, text, score, source)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts that clients know (fixed values).
HEADER = "LLM is not configured, so here are the most relevant local chunks:"
UNREACHABLE = "LLM is configured but unreachable, so here are the most relevant local chunks:"
SYSTEM_PROMPT = "Answer the user's question using only the provided context. Cite sources as [1], [2], ... matching the bracketed indices. If the context does not contain the answer, say so."
RERANK_PREFIX = '<|im_start|>system\nJudge whether the Document meets the requirements based on the Query and the Instruct provided. Note that the answer can only be "yes" or "no".<|im_end|>\n<|im_start|>user\n'
RERANK_SUFFIX = "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"


def rerank(hits: DataFrame, scorer: Callable, query: str, limit: int) -> DataFrame:
    """Hits ordered by ``scorer(query, text column)``, descending and stable, with source 'reranked'."""
    order = (F.desc("score"), F.col("rank"))
    scored = hits.withColumn("score", scorer(query, F.col("text"))).orderBy(*order).limit(limit)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("source", F.lit("reranked"))


def merge_rerank_result(hits: DataFrame, result: DataFrame, limit: int) -> DataFrame:
    """Hits in the order of a rerank service's result (pos, index, relevance_score): rows of null, repeated or unknown
    index are skipped; hits that it leaves out follow in their order with their score."""
    first = result.filter("index is not null and index >= 0").groupBy("index").agg(F.min(F.struct("pos", "relevance_score")).alias("r"))
    joined = hits.join(F.broadcast(first), F.col("rank") - 1 == F.col("index"), "left")
    order = (F.col("r").isNull(), F.col("r.pos"), F.col("rank"))
    top = joined.orderBy(*order).limit(limit).withColumn("new_rank", F.row_number().over(Window.orderBy(*order)))
    return top.withColumns({"score": F.coalesce("r.relevance_score", "score"), "source": F.lit("reranked"), "rank": F.col("new_rank")}).drop("r", "index", "new_rank")


def rerank_prompt(instruction: str, query, text):
    """The text that a cross-encoder reads for a pair; the query is a string or a column."""
    query = F.lit(query) if isinstance(query, str) else query
    return F.concat(F.lit(f"{RERANK_PREFIX}<Instruct>: {instruction}\n<Query>: "), query, F.lit("\n<Document>: "), text, F.lit(RERANK_SUFFIX))


def simple_answer(hits: DataFrame, query: str) -> DataFrame:
    """One row: the numbered texts under a header, or a sentence that there is none."""
    lines = F.array_sort(F.collect_list(F.struct("rank", "text")))
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("["), x.rank.cast("string"), F.lit("] "), x.text)), "\n\n")
    return hits.agg(F.when(F.count(F.lit(1)) == 0, F.lit(f"No local context found for: {query}")).otherwise(F.concat(F.lit(HEADER + "\n\n"), body)).alias("answer"))


def prompt_context(hits: DataFrame) -> DataFrame:
    """One row: the context lines that a language model gets."""
    lines = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text")))
    return hits.agg(F.array_join(F.transform(lines, lambda x: F.format_string("[%d] (chunk_id=%s) %s", x.rank, x.chunk_id, x.text)), "\n\n").alias("context"))


def messages(hits: DataFrame, query: str) -> DataFrame:
    """One row: the (role, content) messages that a language model gets."""
    system = F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content"))
    user = F.struct(F.lit("user").alias("role"), F.concat(F.lit("Context:\n"), F.col("context"), F.lit(f"\n\nQuestion: {query}")).alias("content"))
    return prompt_context(hits).select(F.array(system, user).alias("messages"), "context")


class PlainAnswers:
    """Answers without a model."""

    def answer(self, hits: DataFrame, query: str) -> str:
        return simple_answer(hits, query).first()["answer"]

    def stream(self, hits: DataFrame, query: str) -> Iterator[str]:
        for r in stream_events(hits, query).filter("event = 'delta'").orderBy("seq").collect():
            yield json.loads(r["data"])["content"]


class ModelAnswers:
    """Answers of a service with the common ``/chat/completions`` interface. Where it fails the context itself is the
    answer; where it fails in mid-stream the context follows what was sent. ``transport`` and ``lines`` make the calls."""

    def __init__(self, base_url: str | None, api_key: str | None, model: str | None, transport: Callable, lines: Callable, timeout: float = 60.0):
        if missing := [n for n, v in (("base_url", base_url), ("api_key", api_key), ("model", model)) if not v]:
            raise ValueError(f"{', '.join(missing)} required")
        self.url, self.api_key, self.model = f"{base_url.rstrip('/')}/chat/completions", api_key, model
        self.transport, self.lines, self.timeout = transport, lines, timeout

    def _asked(self, hits: DataFrame, query: str) -> tuple[dict, str] | None:
        row = messages(hits, query).first()
        if not row["context"]:
            return None
        return {"model": self.model, "messages": [m.asDict() for m in row["messages"]], "temperature": 0.2}, f"{UNREACHABLE}\n\n{row['context']}"

    def answer(self, hits: DataFrame, query: str) -> str:
        if (asked := self._asked(hits, query)) is None:
            return f"No local context found for: {query}"
        try:
            return self.transport(self.url, self.api_key, asked[0], self.timeout)["choices"][0]["message"]["content"].strip()
        except Exception:  # noqa: BLE001  a search answers without its model
            return asked[1]

    def stream(self, hits: DataFrame, query: str) -> Iterator[str]:
        if (asked := self._asked(hits, query)) is None:
            yield f"No local context found for: {query}"
            return
        try:
            for line in self.lines(self.url, self.api_key, asked[0] | {"stream": True}, self.timeout):
                if not line.startswith("data: "):
                    continue
                if line[6:].strip() == "[DONE]":
                    return
                if delta := json.loads(line[6:]).get("choices", [{}])[0].get("delta", {}).get("content"):
                    yield delta
        except Exception:  # noqa: BLE001
            yield asked[1]


def stream_events(hits: DataFrame, query: str) -> DataFrame:
    """Server-sent events (seq, event, data): the citations, the answer's parts, the end."""
    cited = hits.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "title", "score"))), lambda x: F.struct(x.chunk_id.alias("chunk_id"), x.title.alias("title"), x.score.alias("score")))).alias("data")).select(F.lit(0).alias("seq"), F.lit("citations").alias("event"), "data")
    answer = simple_answer(hits, query)
    parts = F.when(F.col("answer").startswith(HEADER), F.array(F.lit(HEADER + "\n\n"), F.substr("answer", F.lit(len(HEADER) + 3)))).otherwise(F.array("answer"))
    deltas = answer.select(F.posexplode(parts).alias("pos", "part")).select((F.col("pos") + 1).alias("seq"), F.lit("delta").alias("event"), F.to_json(F.struct(F.col("part").alias("content"))).alias("data"))
    end = hits.sparkSession.range(1).select(F.lit(99).alias("seq"), F.lit("done").alias("event"), F.lit("{}").alias("data"))
    return cited.unionByName(deltas).unionByName(end)


def parse_events(frames: DataFrame) -> DataFrame:
    """(seq, event, data) of the blank-line separated frames in column ``frame``."""
    cut = frames.select(F.posexplode(F.split("frame", "\n\n")).alias("seq", "block")).filter("trim(block) <> ''")
    return cut.select("seq", F.regexp_extract("block", r"(?m)^event: ?(.*)$", 1).alias("event"), F.regexp_extract("block", r"(?m)^data: ?(.*)$", 1).alias("data"))


def parse_model_stream(lines: DataFrame) -> DataFrame:
    """Non-empty deltas (pos, delta) of the ``data: `` lines (pos, line) before the end mark."""
    end = F.coalesce(F.min(F.when(F.col("line") == "data: [DONE]", F.col("pos"))).over(Window.partitionBy()), F.lit(1 << 31))
    return lines.withColumn("end", end).filter("line like 'data: %' and pos < end").select("pos", F.get_json_object(F.substr("line", F.lit(7)), "$.choices[0].delta.content").alias("delta")).filter("delta <> ''")


def render_citation(section, page):
    """'section, page N'; a missing section has a name, a missing or zero page is left out."""
    return F.concat(F.coalesce(section, F.lit("Untitled section")), F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", page "), page.cast("string"))).otherwise(""))
