"""Settings of the pipelines, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 10
    over_fetch: int = 3
    mode: str = "HYBRID"  # VECTOR, KEYWORD or HYBRID
    transform: str = "NONE"
    threshold: float = 0.0
    dedup: bool = True
    dedup_threshold: float = 0.95
    min_chars: int = 0
    max_chars: int = 0
    rerank: str | None = None  # a name in rerank.RERANKERS
    rerank_top_n: int = 20
    rerank_least: float = 0.0
    mmr: bool = False
    mmr_lambda: float = 0.7

    def __post_init__(self):
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")
        if self.mode not in ("VECTOR", "KEYWORD", "HYBRID"):
            raise ValueError(f"unknown search mode: {self.mode}")


@dataclass(frozen=True)
class Ingestion:
    pii: bool = False
    strategy: str | None = None
    classify: bool = False  # ask the classifier where no strategy is configured
    enrich: bool = False
    keywords: int = 5


@dataclass(frozen=True)
class Generation:
    mode: str = "MANUAL"  # or ADVISOR: vector search above a threshold, no judges
    top_k: int = 5
    guard: bool = True
    judge: bool = True
    sufficiency: bool = True
    citations: bool = True
    memory: int = 10  # messages of a conversation that are put before its question
    advisor_threshold: float = 0.7
    sensitive_words: tuple[str, ...] = ()
    cache_similarity: float = 0.95
    # What is said instead of an answer.
    block_message: str = "Your request contains disallowed instructions and cannot be processed."
    insufficient_answer: str = "I don't have enough information in the available context to answer that question."
    sensitive_answer: str = "I'm unable to respond to that due to sensitive content. Could we rephrase or discuss something else?"
    retrieval: Retrieval = field(default_factory=Retrieval)
