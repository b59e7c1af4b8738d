"""Configuration: YAML-like mappings, environment variables, validation; and as small tables."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import table

KINDS = ("telegram", "telegram_user")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    id: str
    type: str
    include_formats: tuple[str, ...] = ("all",)
    settings: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Destination:
    chat_id: str
    token: str = ""
    caption_template: str = "{filename}"


@dataclass(frozen=True)
class Route:
    name: str
    from_sources: tuple[str, ...]
    formats: tuple[str, ...]
    destinations: tuple[Destination, ...] = ()


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...]
    routes: tuple[Route, ...]


def expand(value, env=None):
    """${NAME} in all strings; unset names are empty."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return re.sub(r"\$\{([A-Za-z0-9_]+)\}", lambda m: env.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    return [expand(v, env) for v in value] if isinstance(value, list) else value


def parse(raw: dict, env=None) -> Config:
    raw = expand(raw, env)
    try:
        sources = tuple(Source(str(s["id"]), s["type"], tuple(s.get("selector", {}).get("include_formats", ["all"])), s.get(s["type"], {})) for s in raw["sources"])
        routes = tuple(
            Route(r["name"], tuple(r["from_sources"]), tuple(r["formats"]), tuple(Destination(str(d["chat_id"]), d.get("token", ""), d.get("caption_template", "{filename}")) for d in r.get("destinations", [])))
            for r in raw["publishing"]["routes"]
        )
    except (KeyError, TypeError, AttributeError) as e:
        raise ConfigError(f"missing or wrong: {e}") from e
    return validate(Config(sources, routes))


def validate(config: Config) -> Config:
    ids = [s.id for s in config.sources]
    if len(set(ids)) < len(ids):
        raise ConfigError(f"source ids occur twice: {sorted({i for i in ids if ids.count(i) > 1})}")
    for s in config.sources:
        if s.type not in KINDS:
            raise ConfigError(f"source {s.id}: unknown type {s.type}")
        if s.type == "telegram" and ":" not in str(s.settings.get("token", "")):
            raise ConfigError(f"source {s.id}: a token has a ':'")
        if s.type == "telegram_user" and not str(s.settings.get("api_id", "")).isdigit():
            raise ConfigError(f"source {s.id}: api_id is a number")
    for r in config.routes:
        if unknown := [x for x in r.from_sources if x not in ids]:
            raise ConfigError(f"route {r.name}: unknown sources {unknown}")
    return config


def load(path: str, env=None) -> Config:
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("YAML files need the yaml package; parse() takes mappings") from e
    with open(path, encoding="utf-8") as f:
        try:
            return parse(yaml.safe_load(f) or {}, env)
        except yaml.YAMLError as e:
            raise ConfigError(str(e)) from e


def _places(s: Source) -> tuple[str | None, str]:
    """The chat that a bot's messages must be of, or None; and what a source reads: for users, the peer."""
    chat = s.settings.get("chat_id") if s.type == "telegram" else None
    return None if chat is None else str(chat), str(s.settings.get("peer", s.id))


def tables(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """sources (source_id, source_type, include_formats, chat_id, channel_id, pos), route_sources and route_formats; as small as the configuration."""
    make = partial(table, spark)
    return {
        "sources": make([(s.id, s.type, list(s.include_formats), *_places(s), i) for i, s in enumerate(config.sources)], "source_id string, source_type string, include_formats array<string>, chat_id string, channel_id string, pos int"),
        "route_sources": make([(r.name, s) for r in config.routes for s in r.from_sources], "route string, source_id string"),
        "route_formats": make([(r.name, f) for r in config.routes for f in r.formats], "route string, format string"),
    }
