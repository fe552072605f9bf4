"""Settings: environment, then defaults; blank values count as unset."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    index: str = "index"
    chunks_file: str = "chunks.jsonl"
    embed_model: str = "encoder"
    embed_dim: int = 1024
    chat_model: str = "generator"
    temperature: float = 0.2
    top_k: int = 5

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, prefix: str = "CLAUSEWRIGHT_") -> Config:
        env = os.environ if env is None else env
        given = {f.name: env.get(prefix + f.name.upper(), "").strip() for f in fields(cls)}
        return cls(**{n: type(getattr(cls, n))(v) for n, v in given.items() if v})
