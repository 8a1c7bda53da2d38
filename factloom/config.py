"""Settings of a running service: a JSON file, overridden by environment variables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

MODES = ("all", "worker", "gateway")
#: Environment variables are this and a setting's name in capitals.
PREFIX = "FACTLOOM_"


@dataclass(frozen=True)
class Config:
    """mode: ``gateway`` takes uploads from ``inbox`` to the queue, ``worker`` the queue to the store,
    ``all`` does both. queue: a folder, or ``kafka`` with ``kafka_servers``. batch: files or offsets
    of a micro-batch at most."""

    mode: str = "all"
    driver: str = "parquet"
    store: str = "factloom-store"
    queue: str = "factloom-queue"
    inbox: str = "factloom-inbox"
    checkpoint: str = "factloom-checkpoint"
    dead_letters: str = "factloom-dead"
    kafka_servers: str = ""
    kafka_group: str = ""
    batch: int = 1000
    topics: tuple[str, ...] = ("func", "clazz", "funcctx")

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"no mode {self.mode}")
        if self.queue == "kafka" and not self.kafka_servers:
            raise ValueError("a Kafka queue needs kafka_servers")


def load(path: str | None = None, env: Mapping[str, str] = os.environ) -> Config:
    """Settings of a file, if one is given, then of the environment. An unknown setting is an error."""
    values: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    known = {f.name for f in fields(Config)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    values |= {n: env[PREFIX + n.upper()] for n in known if PREFIX + n.upper() in env}
    for name, kind in (("batch", int), ("topics", lambda t: tuple(t.split(",")) if isinstance(t, str) else tuple(t))):
        if name in values:
            values[name] = kind(values[name])
    return Config(**values)
