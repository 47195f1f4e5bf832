"""Plain helpers of the service: settings, timers, JSON logs, merging of nested options."""

from __future__ import annotations

import json
import logging
import os
import time
from dataclasses import dataclass, fields
from datetime import datetime, timezone


@dataclass(frozen=True)
class Settings:
    """Defaults that SKEIN_<NAME> in the environment overrides."""

    data_dir: str = "skein-data"
    max_file_mb: int = 50
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 100
    top_k: int = 10
    rerank_top_k: int = 5
    threshold: float = 0.3
    vector_weight: float = 0.7
    bm25_weight: float = 0.3
    context_chars: int = 8000
    log_level: str = "INFO"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[f.type](env[f"SKEIN_{f.name.upper()}"]) for f in fields(cls) if f"SKEIN_{f.name.upper()}" in env})


class Timer:
    """with Timer() as t: ...; then t.seconds."""

    def __enter__(self) -> Timer:
        self.began, self.seconds = time.perf_counter(), 0.0
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.perf_counter() - self.began


def deep_merge(base: dict, over: dict) -> dict:
    """base with over's values; dicts that both have are merged."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


class JsonFormatter(logging.Formatter):
    """A log record as one JSON line, with what `extra` gave."""

    _own = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        out |= {k: v for k, v in record.__dict__.items() if k not in self._own}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str)


def json_logging(level: str = "INFO") -> logging.Logger:
    logger = logging.getLogger("skein")
    logger.setLevel(level)
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(JsonFormatter())
        logger.addHandler(handler)
    return logger
