"""Parameters of the detection pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """k: neighbours. tau: largest ratio of an event that is kept. hours: of a sub-window. min_tweets, min_users: support of
    a bursty unit. min_texts: texts that a context needs. budget: g4 (max(floor(sqrt N) + 1, least_budget)), g1 (floor(sqrt N) + 1)
    or a fixed number. similarity: g4, g2, text or g1."""

    k: int = 5
    tau: float = 2.0
    hours: int = 2
    min_tweets: int = 10
    min_users: int = 5
    min_texts: int = 3
    budget: str | int = "g4"
    least_budget: int = 200
    similarity: str = "g4"
    common_lemmas: int = 2
    keep_ranks: int = 5
    lsh_bits: int = 100
    lsh_rounds: int = 20
    lsh_window: int = 50
    lsh_similarity: float = 0.9
