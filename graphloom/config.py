"""Project settings: ``graphloom.toml`` and ``.env`` files."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from graphloom.errors import GraphError


@dataclass
class Alias:
    query: str
    name: str
    args: list[str] = field(default_factory=list)
    format: str | None = None


@dataclass
class Config:
    db: str | None = None
    schema: str | None = None
    roots: list[str] = field(default_factory=lambda: ["."])
    format: str = "table"
    aliases: dict[str, Alias] = field(default_factory=dict)


def read_config(path: str | None = None) -> Config:
    """Settings of a file; without a path, of ./graphloom.toml if it is there. Relative paths are beside the file."""
    if path is None:
        if not os.path.exists("graphloom.toml"):
            return Config()
        path = "graphloom.toml"
    with open(path, "rb") as f:
        try:
            raw = tomllib.load(f)
        except tomllib.TOMLDecodeError as e:
            raise GraphError(f"{path}: {e}") from None
    base = os.path.dirname(os.path.abspath(path))
    at = lambda p: p if p is None or "://" in p or os.path.isabs(p) else os.path.join(base, p)
    aliases = {n: Alias(a["query"], a["name"], list(a.get("args", [])), a.get("format")) for n, a in raw.get("query_aliases", {}).items()}
    roots = [at(r) for r in raw.get("query", {}).get("roots", ["."])]
    return Config(at(raw.get("db", {}).get("default_path")), at(raw.get("schema", {}).get("default_path")), roots, raw.get("cli", {}).get("output_format", "table"), aliases)


def read_env(*paths: str) -> dict[str, str]:
    """NAME=value lines of the files that are there; earlier files and the real environment go first."""
    out: dict[str, str] = {}
    for path in paths:
        if os.path.exists(path):
            with open(path) as f:
                for line in f:
                    name, eq, value = line.strip().removeprefix("export ").partition("=")
                    if eq and not name.startswith("#"):
                        out.setdefault(name.strip(), value.strip().strip("\"'"))
    return {k: os.environ.get(k, v) for k, v in out.items()}


def find_query(config: Config, name: str) -> str:
    for root in config.roots:
        path = name if os.path.isabs(name) else os.path.join(root, name)
        if os.path.exists(path):
            return path
    raise GraphError(f"no query file {name}")
