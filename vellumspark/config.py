"""Settings: explicit values before environment variables before defaults. A given 0 is a value."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

STRATEGIES = ("recursive", "structural", "semantic")
ENRICHMENTS = ("summary", "entities", "keywords", "confidence")
PREFIX = "VELLUM_"


@dataclass(frozen=True)
class ChunkerConfig:
    strategy: str = "recursive"
    chunk_size: int = 512
    chunk_overlap: int = 50
    similarity_threshold: float = 0.75

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
        if self.chunk_size <= 0 or self.chunk_overlap < 0 or not 0 <= self.similarity_threshold <= 1:
            raise ValueError("chunk_size > 0, chunk_overlap >= 0 and similarity_threshold in [0, 1] are asked for")


@dataclass(frozen=True)
class EnrichmentConfig:
    model: str = "extractive"
    temperature: float = 0.0
    enrichments: tuple[str, ...] = ENRICHMENTS
    batch_size: int = 10
    max_concurrency: int = 5
    max_retries: int = 3

    def __post_init__(self) -> None:
        if unknown := set(self.enrichments) - set(ENRICHMENTS):
            raise ValueError(f"unknown enrichments: {', '.join(sorted(unknown))}")
        if not 0 <= self.temperature <= 2 or min(self.batch_size, self.max_concurrency, self.max_retries) < 1:
            raise ValueError("temperature in [0, 2] and counts of 1 or more are asked for")


@dataclass(frozen=True)
class RetrievalConfig:
    vector_weight: float = 0.7
    bm25_weight: float = 0.3
    expand_parents: bool = False
    expand_neighbors: int = 0
    reranker_top_k: int = 5

    def __post_init__(self) -> None:
        if min(self.vector_weight, self.bm25_weight, self.expand_neighbors) < 0 or self.reranker_top_k < 1:
            raise ValueError("weights and distances of 0 or more and reranker_top_k of 1 or more are asked for")


@dataclass(frozen=True)
class PipelineConfig:
    chunker: ChunkerConfig = field(default_factory=ChunkerConfig)
    enrichment: EnrichmentConfig = field(default_factory=EnrichmentConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    enrich: bool = True


def _read(kind: type, text: str) -> object:
    if kind is bool:
        return text.strip().lower() in ("true", "1", "yes")
    if kind is tuple:
        return tuple(x.strip().lower() for x in text.split(",") if x.strip())
    return kind(text)


_FROM_ENVIRONMENT = {
    "strategy": ("chunker", str),
    "chunk_size": ("chunker", int),
    "chunk_overlap": ("chunker", int),
    "similarity_threshold": ("chunker", float),
    "model": ("enrichment", str),
    "temperature": ("enrichment", float),
    "batch_size": ("enrichment", int),
    "max_concurrency": ("enrichment", int),
    "enrichments": ("enrichment", tuple),
    "enrich": ("", bool),
}


def dotenv(path: str) -> dict[str, str]:
    """NAME=value lines of a file; none if it isn't there."""
    try:
        with open(path, encoding="utf-8") as f:
            pairs = [line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
    except FileNotFoundError:
        return {}
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def load_config(env: Mapping[str, str] | None = None, env_file: str = "", **overrides: object) -> PipelineConfig:
    """A configuration from overrides by field name, then env (the process's), then env_file, then defaults."""
    own = os.environ if env is None else env
    found = dotenv(env_file) if env_file else {}
    found |= {k: v for k, v in own.items() if k.startswith(PREFIX)}
    config = PipelineConfig()
    for name, (part, kind) in _FROM_ENVIRONMENT.items():
        if (text := found.get(PREFIX + name.upper(), "")) != "":
            config = _with(config, part, name, _read(kind, text))
    for name, value in overrides.items():
        if value is None:
            continue
        part = next((p for p in ("chunker", "enrichment", "retrieval") if name in {f.name for f in fields(getattr(config, p))}), "")
        if not part and name not in {f.name for f in fields(PipelineConfig)}:
            raise TypeError(f"no setting is named {name}")
        config = _with(config, part, name, value)
    return config


def _with(config: PipelineConfig, part: str, name: str, value: object) -> PipelineConfig:
    return replace(config, **{part: replace(getattr(config, part), **{name: value})}) if part else replace(config, **{name: value})
