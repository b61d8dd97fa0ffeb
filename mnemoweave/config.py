"""Parameters of the operators, passed explicitly (no global singleton)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_size: int = 512
    max_neighbors: int = 5
    ppr_damping: float = 0.85
    max_distance: float = 0.55
    hub_percentile: float = 0.99
    ego_depth: int = 2
    node_budget: int = 10_000
    seed_beta: float = 3.0
    seed_uniform: float = 0.1
    ppr_iterations: int = 100
    history_decay: float = 0.2
    rerank_enabled: bool = False
    fusion_method: str = "weighted_sum"
    rerank_top_n: int = 20
    weight_ppr: float = 0.7
    weight_rerank: float = 0.3
    rrf_k: int = 60


#: Fan-out caps by edge type (for hubs in brackets), type budgets.
P2P, H2P, P2H = 2, 1, 0  # phrase-phrase, passage-phrase, phrase-passage
FANOUT = {P2H: (64, 48), H2P: (128, 128), P2P: (32, 16)}
TYPE_BUDGET = {P2H: 12_000, H2P: 12_000, P2P: 4_000}
#: Decay rates a second and purge grace by memory kind, in days.
DECAY_DAYS = {"fact": 30, "preference": 14, "task": 7}
DECAY_DAYS_OTHER = 21
GRACE_DAYS = {"fact": 30, "preference": 14, "task": 7}
GRACE_DAYS_OTHER = 14


def node_budget(available_mb: float, alpha: float, n_max: int) -> int:
    """How many nodes a subgraph may have with so much memory."""
    return max(500, min(n_max, int(available_mb * 1024 * alpha / 2)))


#: Fixed values: (alpha, most nodes) of the memory profiles, and the memory in MB below which each is chosen.
PROFILES = {"low": (0.05, 2_000), "mid": (0.10, 5_000), "high": (0.20, 10_000), "max": (1.0, 1_000_000)}
PROFILE_BELOW_MB = {"low": 4_000, "mid": 8_500, "high": 16_500}


def profile(name: str, total_mb: float = 0, n_max: int | None = None, alpha: float | None = None) -> tuple[float, int]:
    """(alpha, most nodes) of a profile; "auto" goes by the memory, an unknown name is "mid"; overrides win."""
    if name == "auto":
        name = next((k for k, below in PROFILE_BELOW_MB.items() if total_mb < below), "max")
    a, n = PROFILES.get(name, PROFILES["mid"])
    return alpha or a, n_max or n


def available_mb(free_mb: float, swap_free_mb: float = 0, zram: bool = False) -> float:
    """Memory to plan with: compressed swap counts half."""
    return free_mb + (swap_free_mb * 0.5 if zram else 0)
