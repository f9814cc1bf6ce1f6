"""Settings of a mining run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MinerConfig:
    """timestamps: number of snapshots T. k: most edges of a pattern. gamma: active attributes kept. n_edges: edge
    types kept. match_mode: ``structural`` joins edge by edge; ``signature`` crosses the vertices of a
    neighbourhood whose edge types are exactly the pattern's. min_level: least edges of a pattern that reports
    rules. max_dependencies: bound on the dependencies of one pattern."""

    timestamps: int
    k: int = 4
    gamma: int = 20
    n_edges: int = 10
    theta_pattern: float = 1e-6
    theta_rule: float = 8e-5
    match_mode: str = "structural"
    min_level: int = 2
    max_dependencies: int = 10_000
