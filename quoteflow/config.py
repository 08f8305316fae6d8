"""Job configuration, checked before anything starts."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any

from quoteflow.functions.formats import FORMATS

FILES_AT_ONCE = 8
STORE_VARIABLE = "QUOTEFLOW_STORE"


class ConfigError(ValueError):
    """The configuration is missing something or names something unknown."""


@dataclass(frozen=True)
class Source:
    name: str
    uri: str
    format: str


@dataclass(frozen=True)
class SinkOptions:
    """How a batch reaches the store, and what happens if it does not."""

    batch_size: int = 500  # rows per round trip to a database, see sources.store.jdbc_sink
    max_latency: timedelta = timedelta(seconds=1)  # time between micro-batches
    max_files: int | None = None  # landed files that one micro-batch takes
    max_rows: int | None = None  # ticks that one micro-batch takes; files are landed small enough for that
    max_attempts: int = 5
    backoff_initial: timedelta = timedelta(milliseconds=200)
    backoff_max: timedelta = timedelta(seconds=5)
    backoff_factor: float = 2.0
    on_exhausted: str = "dead_letter"  # or "fail": stop, replay from the checkpoint, lose nothing

    def __post_init__(self) -> None:
        if self.max_attempts < 1:
            raise ConfigError("max_attempts must be at least 1")
        if self.batch_size < 1 or (self.max_files is not None and self.max_files < 1):
            raise ConfigError("batch_size and max_files must be at least 1")
        if self.max_rows is not None and self.max_rows < 1:
            raise ConfigError("max_rows must be at least 1")
        if self.backoff_initial <= timedelta(0):
            raise ConfigError("backoff_initial must be positive")
        if self.backoff_max < self.backoff_initial:
            raise ConfigError("backoff_max must not be below backoff_initial")
        if self.backoff_factor < 1:
            raise ConfigError("backoff_factor must be at least 1")
        if self.on_exhausted not in ("dead_letter", "fail"):
            raise ConfigError(f"on_exhausted must be 'dead_letter' or 'fail', not {self.on_exhausted!r}")

    @property
    def files_per_batch(self) -> int | None:
        """Landed files that one micro-batch takes; several, so that they are read side by side."""
        return self.max_files if self.max_rows is None else min(self.max_files or FILES_AT_ONCE, self.max_rows)

    @property
    def rows_per_file(self) -> int | None:
        """Rows of a landed file, so that no micro-batch has more than ``max_rows``."""
        return None if self.max_rows is None else self.max_rows // self.files_per_batch

    def delay_ceiling(self, failures: int) -> timedelta:
        """The longest wait after that many failed attempts."""
        return min(self.backoff_initial * self.backoff_factor ** (failures - 1), self.backoff_max)


@dataclass(frozen=True)
class JobConfig:
    store: str
    sources: tuple[Source, ...]
    drain_timeout: timedelta = timedelta(seconds=10)
    dedup_window: timedelta = timedelta(minutes=2)
    sink: SinkOptions = field(default_factory=SinkOptions)

    @staticmethod
    def load(settings: Mapping[str, Any], env: Mapping[str, str] | None = None) -> JobConfig:
        """Build and check a configuration; the environment overrides where the store is."""
        env = os.environ if env is None else env
        store = env.get(STORE_VARIABLE, "").strip() or str(settings.get("store") or "").strip()
        if not store:
            raise ConfigError(f"no store configured: set 'store' or {STORE_VARIABLE}")
        window = timedelta(seconds=settings.get("dedup_window_seconds", 120))
        if window <= timedelta(0):
            raise ConfigError("dedup_window_seconds must be positive")
        return JobConfig(
            store=store,
            sources=check_sources(settings.get("sources") or []),
            drain_timeout=timedelta(seconds=settings.get("drain_timeout_seconds", 10)),
            dedup_window=window,
            sink=SinkOptions(**settings.get("sink", {})),
        )


def check_sources(rows: list[Mapping[str, Any]]) -> tuple[Source, ...]:
    """At least one source, each with a name, a uri and a known format."""
    if not rows:
        raise ConfigError("no sources configured")
    sources = []
    for i, row in enumerate(rows):
        name = str(row.get("name") or "").strip()
        if not name:
            raise ConfigError(f"source at index {i} has no name")
        for required in ("uri", "format"):
            if not str(row.get(required) or "").strip():
                raise ConfigError(f"source '{name}' has no {required}")
        fmt = str(row["format"]).strip().upper()
        if fmt not in FORMATS:
            raise ConfigError(f"source '{name}': unknown format '{row['format']}', expected one of {sorted(FORMATS)}")
        sources.append(Source(name, str(row["uri"]).strip(), fmt))
    check_names([s.name for s in sources])
    return tuple(sources)


def check_names(names: list[str]) -> None:
    """Every frame of a name listed twice would count twice."""
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise ConfigError(f"source '{twice[0]}' is configured more than once")
