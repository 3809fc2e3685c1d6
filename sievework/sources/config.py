"""Settings of a scan: defaults, over them a JSON file, over that what the caller gives."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields, replace
from pathlib import Path

from sievework.plans.catalog import MAX_FULL_BYTES, MAX_LITE_BYTES


@dataclass(frozen=True)
class Config:
    """What a scan can be told. Keys of the file are these names in camel case."""

    mode: str = "source"
    max_files: int = 3000
    max_bytes_per_file: int = MAX_FULL_BYTES
    hard_max_bytes_per_file: int = MAX_LITE_BYTES
    max_findings: int = 300
    max_plugins: int = 12
    trusted_scopes: tuple[str, ...] = ("@deepseek-ai",)
    ignore: tuple[str, ...] = ()
    include_build_artifacts: bool = False
    redact_secrets: bool = True
    redact_paths: bool = False
    advisories: bool = False
    fail_on: str | None = "high"


def _key(name: str) -> str:
    return re.sub(r"_(.)", lambda m: m[1].upper(), name)


def _over(config: Config, given: dict) -> Config:
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    return replace(config, **given | {"redact_secrets": True})


def load(path: str | Path) -> Config:
    """The file's settings over the defaults; a file that is not there changes nothing, unknown keys do not either. Secrets are
    redacted whatever the file says. Raises ValueError with the path for a file that is no JSON object."""
    path = Path(path)
    if not path.exists():
        return Config()
    try:
        raw = json.loads(path.read_text("utf-8"))
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e
    if not isinstance(raw, dict):
        raise ValueError(f"{path}: not an object")
    return _over(Config(), {f.name: raw[_key(f.name)] for f in fields(Config) if _key(f.name) in raw})


def merge(config: Config, **given: object) -> Config:
    """config with the settings that are given; None leaves one as it is."""
    return _over(config, {k: v for k, v in given.items() if v is not None})
