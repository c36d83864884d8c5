"""Settings of the engine, with the defaults that queries run with."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    data_dir: str = "store"
    chunk_target_tokens: int = 400
    chunk_overlap_ratio: float = 0.15
    vector_top_k: int = 8
    keyword_top_k: int = 8
    context_token_budget: int = 3000
    min_words_for_decompose: int = 8
    max_words_simple: int = 30
    conjunctions: tuple[str, ...] = (" and ", " as well as ", " along with ", " & ", " plus ")
    max_subqueries: int = 4
    max_candidates: int = 20
    excerpt_chars: int = 300
    relevance_threshold: float = 0.3
    evidence_top_n: int = 12
    verify: bool = True
    cache_max_size: int = 1000
    cache_ttl_s: float = 3600.0
    memory_max_turns: int = 10
    memory_max_items: int = 100
    memory_context_budget: int = 400
    memory_top_k_facts: int = 5
    related_limit: int = 50
    direct_summary_tokens: int = 5000


def load_settings(path: str | None = None) -> Settings:
    """Defaults, overridden by the known keys of a TOML file; unknown keys are ignored. LODESTONE_DIR sets the data folder."""
    made = Settings()
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            given = tomllib.load(f)
        known = {x.name for x in fields(Settings)}
        made = replace(made, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})
    return replace(made, data_dir=os.environ["LODESTONE_DIR"]) if "LODESTONE_DIR" in os.environ else made
