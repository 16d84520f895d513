"""Provenance record of a delivered dataset, and the draft file name."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from stemledger import __version__

SCHEMA_VERSION = "paired-census-v1"


@dataclass(frozen=True)
class Provenance:
    build: str
    app_version: str
    schema_version: str
    dsn: str
    timestamp: str

    @classmethod
    def draft(
        cls, dsn: str, timestamp: str | None = None, schema_version: str = SCHEMA_VERSION
    ) -> "Provenance":
        """Stamp of a draft. This package makes no other kind."""
        now = timestamp or datetime.now(timezone.utc).isoformat()
        return cls("draft", __version__, schema_version, dsn, now)

    def items(self) -> list[tuple[str, str]]:
        return list(asdict(self).items())

    def comment_line(self) -> str:
        return "# " + " ".join(f"{key}={value}" for key, value in self.items())

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def draft_name(base: str, extension: str) -> str:
    return f"{base}_DRAFT.{extension}"
