"""Settings from the environment, with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    warehouse: str = "spark-warehouse"
    chunk_size: int = 512
    chunk_overlap: int = 64
    top_k: int = 5
    rrf_k: int = 60
    vector_dim: int = 64
    token_budget: int = 2048
    graph_enabled: bool = True

    @classmethod
    def load(cls, env: dict | None = None, prefix: str = "LEXIVEC_") -> Settings:
        env, own = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                own[f.name] = raw.lower() in ("1", "true", "yes", "on") if isinstance(f.default, bool) else type(f.default)(raw)
        return cls(**own)
