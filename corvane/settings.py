"""What an engine is told by the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from .functions.text import retrieval_mode


@dataclass(frozen=True)
class Settings:
    root: str = "corvane-data"
    mode: str = "hybrid"
    k: int = 8
    chunk_size: int = 1000
    chunk_overlap: int = 180
    embedding_size: int = 32
    algorithm: str = "label"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """CORVANE_ROOT, CORVANE_MODE, CORVANE_K, ...; a value that can't be meant is an error."""
        env = os.environ if env is None else env
        values = {}
        for name, field in cls.__dataclass_fields__.items():
            raw = env.get(f"CORVANE_{name.upper()}", "").strip()
            if raw:
                try:
                    values[name] = int(raw) if isinstance(field.default, int) else raw
                except ValueError:
                    raise ValueError(f"CORVANE_{name.upper()} must be a whole number, not {raw!r}") from None
        made = cls(**values)
        if made.algorithm not in ("label", "louvain", "greedy"):
            raise ValueError(f"CORVANE_ALGORITHM must be label, louvain or greedy, not {made.algorithm!r}")
        return cls(**{**values, "mode": retrieval_mode(made.mode)})
