"""Settings: defaults, a mapping (as from YAML), environment variables over it; unknown keys are errors."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Ocr:
    strategy: str = "auto"
    languages: str = "deu+frk+eng"
    max_pdf_mib: int = 100
    timeout_secs: int = 300
    max_response_mib: int = 64
    workers: int = 2
    max_attempts: int = 3
    url: str = ""


@dataclass(frozen=True)
class Config:
    region: str = "us-east-1"
    bucket: str = ""
    prefix: str = ""
    max_text_bytes: int = 524_288
    index_warc_responses: bool = True
    max_results: int = 50
    pdf_url_key: str = "pdf-urls-{timestamp}.txt"
    skip_domains: tuple[str, ...] = ()
    skip_patterns: tuple[str, ...] = ()
    collections: tuple[str, ...] = ()
    ocr: Ocr = field(default_factory=Ocr)


def _build(kind, values: dict, where: str):
    known = {f.name: f for f in fields(kind)}
    unknown = set(values) - set(known)
    if unknown:
        raise KeyError(f"{where}: unknown keys {sorted(unknown)}")
    made = {k: _build(Ocr, v, f"{where}.{k}") if k == "ocr" else tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    return kind(**made)


def load(values: dict | None = None, env: dict[str, str] | None = None) -> Config:
    """``LODESTRATA_KEY`` sets a key, ``LODESTRATA_OCR_KEY`` one of ocr; numbers must be numbers."""
    config = _build(Config, values or {}, "config")
    env = dict(os.environ) if env is None else env
    for name, value in env.items():
        if not name.startswith("LODESTRATA_"):
            continue
        key = name.removeprefix("LODESTRATA_").lower()
        part, key = ("ocr", key.removeprefix("ocr_")) if key.startswith("ocr_") else ("", key)
        own = config.ocr if part else config
        if key not in {f.name for f in fields(own)}:
            continue
        now = getattr(own, key)
        new = value.lower() in ("1", "true", "yes") if isinstance(now, bool) else int(value) if isinstance(now, int) else tuple(value.split(",")) if isinstance(now, tuple) else value
        config = replace(config, ocr=replace(own, **{key: new})) if part else replace(config, **{key: new})
    return config


def with_override(base: Ocr, override: dict, url_too: bool = False) -> Ocr:
    """What the override sets; the URL only where that is allowed; the rest is inherited."""
    own = {k: v for k, v in override.items() if v is not None and (k != "url" or url_too)}
    return _build(Ocr, {**{f.name: getattr(base, f.name) for f in fields(Ocr)}, **own}, "ocr")
