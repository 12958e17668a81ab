"""Settings: flags over environment over defaults, checked when they are read."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path


class ConfigError(ValueError):
    """A setting is malformed or out of its range."""


@dataclass(frozen=True)
class EngineConfig:
    roots: tuple[str, ...]
    index_path: str
    max_file_size: int = 104_857_600
    token_budget: int = 110
    hybrid_weight: float = 0.6
    grouping: str | None = None
    max_distance: float | None = None
    max_files: int | None = None
    allow_private_urls: bool = False
    ocr_lang: str = "eslav"
    ocr_min_chars_per_page: int = 25
    dim: int = 8


_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off", ""}


class _Reader:
    def __init__(self, env: Mapping[str, str]):
        self.env = env

    def number(self, name: str, default, kind=int, least=None, most=None):
        raw = self.env.get(name)
        if raw is None:
            return default
        try:
            value = kind(raw)
        except ValueError as e:
            raise ConfigError(f"{name} must be a number, got {raw!r}") from e
        if value != value or (least is not None and value < least) or (most is not None and value > most):
            raise ConfigError(f"{name} must be within {least} and {most}, got {raw!r}")
        return value

    def choice(self, name: str, allowed: tuple[str, ...]) -> str | None:
        value = self.env.get(name)
        if value is not None and value not in allowed:
            raise ConfigError(f"{name} must be one of {allowed}, got {value!r}")
        return value

    def switch(self, name: str) -> bool:
        value = self.env.get(name, "").strip().lower()
        if value not in _TRUE | _FALSE:
            raise ConfigError(f"{name} must be a yes or a no, got {value!r}")
        return value in _TRUE


def _roots(env: Mapping[str, str], flags: Sequence[str], cwd: Path) -> tuple[str, ...]:
    given: list[str] = list(flags)
    if not given and env.get("BASE_DIRS"):
        try:
            given = json.loads(env["BASE_DIRS"])
        except json.JSONDecodeError as e:
            raise ConfigError(f"BASE_DIRS must be a JSON array: {e}") from e
        if not isinstance(given, list) or not given or not all(isinstance(x, str) and x for x in given):
            raise ConfigError("BASE_DIRS must be an array of non-empty strings")
    given = given or [env.get("BASE_DIR") or str(cwd)]
    return tuple(str(Path(x).expanduser().resolve()) for x in given)


def load_config(env: Mapping[str, str], base_dirs: Sequence[str] = (), index_path: str | None = None, cwd: Path | None = None) -> EngineConfig:
    read = _Reader(env)
    roots = _roots(env, base_dirs, (cwd or Path.cwd()).resolve())
    lang = env.get("RAG_OCR_LANG", "eslav").strip()
    if not lang:
        raise ConfigError("RAG_OCR_LANG must not be blank")
    return EngineConfig(
        roots=roots,
        index_path=index_path or env.get("DB_PATH") or f"{roots[0]}/.passagemill/index",
        max_file_size=read.number("MAX_FILE_SIZE", 104_857_600, int, 1),
        token_budget=read.number("CHUNK_TOKEN_BUDGET", 110, int, 16, 128),
        hybrid_weight=read.number("RAG_HYBRID_WEIGHT", 0.6, float, 0.0, 1.0),
        grouping=read.choice("RAG_GROUPING", ("similar", "related")),
        max_distance=read.number("RAG_MAX_DISTANCE", None, float, 0.0),
        max_files=read.number("RAG_MAX_FILES", None, int, 1),
        allow_private_urls=read.switch("ALLOW_PRIVATE_URLS"),
        ocr_lang=lang,
        ocr_min_chars_per_page=read.number("RAG_OCR_MIN_CHARS_PER_PAGE", 25, int, 0),
    )
