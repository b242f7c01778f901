"""Settings: defaults, a YAML file over them, environment variables over both."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Service:
    base_url: str = ""
    api_key: str = ""
    model: str = "gpt-4o"
    embedding_model: str = "text-embedding-3-large"
    temperature: float = 0.2
    max_retries: int = 3
    timeout: float = 120.0


@dataclass(frozen=True)
class Extraction:
    vote_count: int = 3
    min_vote_margin: int = 1
    gleaning_rounds: int = 1
    validation_rounds: int = 1
    min_case_chars: int = 80


@dataclass(frozen=True)
class Fusion:
    string_threshold: float = 0.72
    combined_threshold: float = 0.80
    nil_threshold: float = 0.68
    string_weight: float = 0.4
    vector_weight: float = 0.6
    same_type_only: bool = True
    use_embeddings: bool = True
    top_k: int = 10


@dataclass(frozen=True)
class Causal:
    outcome: str = "severe_consequence"
    min_support: int = 20
    top_k: int = 24
    max_controls: int = 12
    bootstrap_n: int = 500
    refuter_n: int = 100
    seed: int = 2026


@dataclass(frozen=True)
class GraphDatabase:
    uri: str = ""
    user: str = ""
    password: str = ""


@dataclass(frozen=True)
class Settings:
    root: str = "."
    service: Service = field(default_factory=Service)
    extraction: Extraction = field(default_factory=Extraction)
    fusion: Fusion = field(default_factory=Fusion)
    causal: Causal = field(default_factory=Causal)
    graph: GraphDatabase = field(default_factory=GraphDatabase)

    def path(self, name: str) -> str:
        """A path below the root; absolute ones and URIs stay."""
        return name if name.startswith("/") or "://" in name else f"{self.root.rstrip('/')}/{name}"


def _over(base: Any, said: dict) -> Any:
    known = {f.name for f in fields(base)}
    return replace(base, **{k: _over(getattr(base, k), x) if is_dataclass(getattr(base, k)) else x for k, x in said.items() if k in known and x is not None})


def load_env_file(path: str | Path) -> dict[str, str]:
    """KEY=VALUE lines of a file; comments and blank lines aside."""
    if not Path(path).exists():
        return {}
    pairs = (x.partition("=") for x in map(str.strip, Path(path).read_text(encoding="utf-8").splitlines()) if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}


def load_settings(path: str | Path | None = None, env: dict[str, str] | None = None) -> Settings:
    said = {}
    if path:
        import yaml

        said = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    env = dict(os.environ) if env is None else env
    names = {"service": {"LLM_BASE_URL": "base_url", "LLM_API_KEY": "api_key", "LLM_MODEL": "model"}, "graph": {"NEO4J_URI": "uri", "NEO4J_USER": "user", "NEO4J_PASSWORD": "password"}}
    over = {part: {to: env[k] for k, to in keys.items() if env.get(k)} for part, keys in names.items()}
    return _over(_over(Settings(), said), over)
