"""Settings: a JSON object over defaults. Missing files and keys keep the defaults, keys that
are not known are left alone, a byte order mark and bad bytes are tolerated."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

from ..schema import ANSWER_BUDGET, WATCHED_NAMES

#: Names another file than the usual one.
ENVIRONMENT = "PROVENA_CONFIG"
USUAL = Path.home() / ".config" / "provena" / "config.json"


@dataclass(frozen=True)
class Config:
    source_dirs: tuple[str, ...] = ()
    map_path: str = ""
    answer_budget: int = ANSWER_BUDGET
    watched_names: tuple[str, ...] = WATCHED_NAMES

    @staticmethod
    def place(path: str | Path | None = None) -> Path:
        return Path(path or os.environ.get(ENVIRONMENT) or USUAL)

    @classmethod
    def read(cls, path: str | Path | None = None) -> Config:
        file = cls.place(path)
        given = json.loads(file.read_bytes().decode("utf-8-sig", "replace")) if file.is_file() else {}
        known = {f.name: tuple(v) if isinstance(v := given[f.name], list) else v for f in fields(cls) if f.name in given}
        return replace(cls(), **known)

    def write(self, path: str | Path | None = None) -> Path:
        file = self.place(path)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps({f.name: getattr(self, f.name) for f in fields(self)}, ensure_ascii=False, sort_keys=True, indent=1) + "\n", encoding="utf-8")
        return file
