"""Retrieval settings: typed defaults, loading, coercion."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Config:
    """All settings with their default values; unknown stored keys are kept in ``extra``."""

    rag_enabled: bool = True
    top_k: int = 5
    max_inject_tokens: int = 1800
    max_chunk_chars: int = 1600
    cosine_floor: float = 0.32
    min_token_coverage: float = 0.5
    min_identifier_hits: int = 1
    relative_threshold: float = 0.45
    rrf_k: int = 60
    w_identifier: float = 0.25
    w_coverage: float = 0.5
    w_cosine: float = 0.5
    file_name_boost: float = 0.12
    max_per_file: int = 2
    near_dup_cosine: float = 0.92
    chunk_target_lines: int = 80
    chunk_min_lines: int = 25
    chunk_overlap_lines: int = 8
    max_file_bytes: int = 2_000_000
    stale_after_hours: float = 24
    model: str = "hash-384"
    dtype: str = "float"
    query_prefix: str = ""
    passage_prefix: str = ""
    semantic_timeout_ms: int = 8000
    extra_extensions: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    tracked_paths: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    @property
    def candidates(self) -> int:
        """How many candidates each ranking gives."""
        return candidate_width(self.top_k)


def candidate_width(top_k: int) -> int:
    return min(200, max(40, top_k * 8))


_KNOWN = {f.name: f for f in fields(Config) if f.name != "extra"}


def _snake(key: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in key)


def load_config(text: str | None) -> Config:
    """Defaults overlaid by a JSON object; anything malformed gives the defaults."""
    try:
        stored = json.loads(text or "{}")
    except ValueError:
        return Config()
    if not isinstance(stored, dict):
        return Config()
    known = {_snake(k): v for k, v in stored.items() if _snake(k) in _KNOWN}
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in known.items()}
    return replace(Config(), **known, extra={k: v for k, v in stored.items() if _snake(k) not in _KNOWN})


def dump_config(config: Config) -> str:
    stored = asdict(config)
    return json.dumps(stored.pop("extra") | stored, indent=2)


def set_value(config: Config, key: str, value) -> Config:
    """One setting changed: unknown keys are refused, values take the type of the default."""
    name = _snake(key)
    if name not in _KNOWN:
        raise KeyError(f"unknown setting {key!r}; known: {', '.join(_KNOWN)}")
    default = getattr(Config(), name)
    if isinstance(default, bool):
        value = value is True or value in ("true", "1")
    elif isinstance(default, (int, float)):
        number = float(value)
        value = int(number) if isinstance(default, int) and number.is_integer() else number
    elif isinstance(default, tuple):
        value = tuple(value) if isinstance(value, (list, tuple)) else (value,)
    else:
        value = str(value)
    return replace(config, **{name: value})
