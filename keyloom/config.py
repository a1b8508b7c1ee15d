"""Options: defaults, then a JSON file, then environment variables KEYLOOM_<OPTION>; each table may override."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Options:
    #: Bytes of one generation of a log before it is rotated.
    log_bytes: int = 100 << 20
    #: Bytes of uncompacted log at which a write is followed by a compaction; 0: never by itself.
    compact_bytes: int = 0
    #: Level of what the library reports through Python's logging: debug, info, warning, error.
    trace: str = "warning"
    #: Buckets of a new table's snapshots; a point read opens one.
    buckets: int = 16
    #: Live share at or below which a snapshot version is rewritten.
    utilisation: float = 0.5
    #: Bytes that resident tables may hold before the least recently used go.
    memory: int = 1 << 30
    #: Share of the bytes in use that an eviction frees.
    freed: float = 0.4
    tables: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None, env: dict | None = None) -> Options:
        given = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
        for f in fields(cls):
            if (raw := (os.environ if env is None else env).get(f"KEYLOOM_{f.name.upper()}")) is not None:
                given[f.name] = json.loads(raw)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"no such options: {sorted(unknown)}")
        return cls(**given)

    def of(self, table: str) -> Options:
        return replace(self, **self.tables.get(table, {}))
