"""The knobs of a curation run and their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CurationConfig:
    session_id: str = "local"
    goal: str = ""
    format: str = "qa"
    chunk_size: int = 512
    chunk_overlap: int = 64
    #: A byte-pair vocabulary file that chunks are bounded and counted by; None: the pre-token pattern.
    vocabulary: str | None = None
    min_page_words: int = 50
    max_pages: int | None = None
    max_crawl_pages: int = 50
    max_crawl_depth: int = 3
    n_per_chunk: int = 3
    custom_system: str = ""
    quality_threshold: float = 0.5
    min_question_words: int = 5
    min_answer_words: int = 10
    review_batch: int = 5
    review_cost_cap: float = 1.0
    review_min_score: int = 3
    validation_ratio: float = 0.1
    split_seed: int = 42
    split_min_rows: int = 10
    skip_known: bool = False
    sanitise_discovered: bool = False
