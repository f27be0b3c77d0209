"""Settings from the environment or a .env file, and what they choose: embedding, reranker and answer generator."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pagewright.operators import answers, providers, search


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values. A setting is read from the upper-cased name of its field; unknown names are ignored."""

    storage_docs_path: str = "storage/docs"
    index_path: str = "storage/index"
    embedding_provider: str = "local"
    embedding_model: str = "BAAI/bge-small-zh-v1.5"
    embedding_dimensions: int = 512
    embedding_api_base_url: str | None = None
    embedding_api_key: str | None = None
    reranker_enabled: bool = True
    reranker_provider: str = "local"
    reranker_model: str = "Qwen/Qwen3-Reranker-0.6B"
    reranker_api_base_url: str | None = None
    reranker_api_key: str | None = None
    rrf_k: int = search.RRF_K
    rerank_top_k: int = 20
    llm_api_base_url: str | None = None
    llm_api_key: str | None = None
    llm_model: str | None = None

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, env_file: str | None = None) -> Settings:
        """From the environment, which wins over the lines ``NAME=value`` of a file that need not exist."""
        found: dict[str, str] = {}
        if env_file and os.path.exists(env_file):
            with open(env_file, encoding="utf-8") as f:
                for line in f:
                    name, mark, value = line.strip().partition("=")
                    if mark and not name.startswith("#"):
                        found[name.strip().upper()] = value.strip().strip("\"'")
        found |= {k.upper(): v for k, v in (os.environ if env is None else env).items()}
        made = {}
        for f in fields(cls):
            if (value := found.get(f.name.upper())) is not None:
                kind = type(f.default)
                made[f.name] = value.strip().lower() in ("1", "true", "yes", "on") if kind is bool else int(value) if kind is int else value
        return cls(**made)


def make_embedding(settings: Settings, load: Callable | None = None, transport: Callable = providers.post_json):
    """The service where ``openai`` is chosen, with an error where a setting of it is missing, so that no other model's
    vectors get into an index unseen; else the local model that ``load`` gives, or the hash embedding without one."""
    if settings.embedding_provider == "openai":
        needed = {"EMBEDDING_API_BASE_URL": settings.embedding_api_base_url, "EMBEDDING_API_KEY": settings.embedding_api_key, "EMBEDDING_MODEL": settings.embedding_model}
        if missing := [name for name, value in needed.items() if not value]:
            raise ValueError(f"the embedding service needs {', '.join(missing)}")
        return providers.ServiceEmbedding(settings.embedding_api_base_url, settings.embedding_api_key, settings.embedding_model, settings.embedding_dimensions, transport=transport)
    return providers.LocalEmbedding(load, settings.embedding_dimensions) if load else providers.HashEmbedding()


def make_reranker(settings: Settings, score: Callable | None = None, transport: Callable = providers.post_json, load: Callable | None = None):
    """None where reranking is off or a service lacks its address, key (the embedding's serves too) or model; else the
    service or the cross-encoder around ``score`` or what ``load`` gives."""
    if not settings.reranker_enabled:
        return None
    if settings.reranker_provider == "api":
        key = settings.reranker_api_key or settings.embedding_api_key
        if not (settings.reranker_api_base_url and key and settings.reranker_model):
            return None
        return providers.ServiceReranker(settings.reranker_api_base_url, key, settings.reranker_model, transport=transport)
    return providers.CrossEncoder(score, load=load) if score or load else None


def make_answers(settings: Settings, transport: Callable = providers.post_json, lines: Callable = providers.post_lines):
    """The language model's answers where address, key and model are set, else the plain ones."""
    if settings.llm_model and settings.llm_api_key and (settings.llm_api_base_url or "").strip():
        return answers.ModelAnswers(settings.llm_api_base_url, settings.llm_api_key, settings.llm_model, transport, lines)
    return answers.PlainAnswers()
