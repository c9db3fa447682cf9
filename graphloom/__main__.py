"""The command line: ``python -m graphloom COMMAND``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from graphloom import __version__
from graphloom.config import find_query, read_config
from graphloom.errors import GraphError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("graphloom")
    p.add_argument("--config")
    p.add_argument("--quiet", "-q", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str, **more) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--db")
        for o in options:
            c.add_argument(o, **({"action": "store_true"} if o in more.get("flags", ()) else {}))
        return c

    add("version")
    add("init", "--schema")
    c = add("load", "--data", "--mode")
    c = add("run", "--query", "--name", "--format")
    c.add_argument("alias", nargs="?")
    c.add_argument("args", nargs="*")
    c.add_argument("--param", action="append", default=[])
    add("check", "--query")
    add("describe", "--type")
    add("export", "--no-embeddings", flags=("--no-embeddings",))
    c = add("changes", "--format")
    for o in ("--since", "--from", "--to"):
        c.add_argument(o, type=int)
    c = add("embed", "--type", "--property", "--all", "--dry-run", flags=("--all", "--dry-run"))
    c.add_argument("--limit", type=int)
    add("compact")
    c = add("cleanup")
    c.add_argument("--older-than", type=float, default=86_400.0, help="seconds that a folder must have been left alone")
    c.add_argument("--keep", type=int, default=1)
    add("doctor")
    add("schema-diff", "--from", "--to")
    add("migrate", "--schema", "--confirm", "--dry-run", flags=("--confirm", "--dry-run"))
    return p


def session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def typed(params: list[str], declared: dict) -> dict:
    """NAME=value arguments as the declared types have them."""
    out = {}
    for item in params:
        name, _, value = item.partition("=")
        t = declared.get(name)
        out[name] = value if t is None or (t.scalar in ("String", "Date", "DateTime") and not t.vector) else json.loads(value)
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a, spark)
    except (GraphError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run(a: argparse.Namespace, spark) -> int:
    from graphloom import formats
    from graphloom.database import GraphDB
    from graphloom.plans import migrate as M
    from graphloom.streaming import feed

    config = read_config(a.config)
    say = (lambda *x: None) if a.quiet else print
    if a.command == "schema-diff":
        kind, steps = M.diff(_read(getattr(a, "from")), _read(a.to))
        print(json.dumps({"kind": kind, "steps": [dataclasses.asdict(s) for s in steps]}))
        return 0
    path = a.db or config.db
    if a.command == "version" and path is None:
        print(__version__)
        return 0
    if path is None:
        raise GraphError("give --db, or db.default_path in graphloom.toml")
    spark = spark or session()
    if a.command == "init":
        GraphDB.init(spark, path, _read(a.schema or config.schema))
        say(f"created {path}")
        return 0
    db = GraphDB.open(spark, path)
    if a.command == "version":
        print(f"{__version__}, database version {db.store.version().number}")
    elif a.command == "load":
        say(f"version {db.load_file(a.data, a.mode).number}")
    elif a.command == "run":
        alias = config.aliases.get(a.alias) if a.alias else None
        if a.alias and alias is None:
            raise GraphError(f"no alias {a.alias}")
        source = _read(find_query(config, alias.query if alias else a.query))
        q = db.query(source, alias.name if alias else a.name)
        params = [*([f"{n}={v}" for n, v in zip(alias.args, a.args, strict=False)] if alias else []), *a.param]
        out = db.run(source, q.name, typed(params, q.params))
        if dataclasses.is_dataclass(out):
            print(json.dumps(dataclasses.asdict(out)))
        else:
            meta = {} if a.quiet else {"name": q.name, "description": q.description, "instruction": q.instruction}
            print(formats.render(out, a.format or (alias and alias.format) or config.format, **meta))
    elif a.command == "check":
        found = db.check(_read(find_query(config, a.query)))
        for f in found:
            print(f"{f.code} {f.query} {f.message}")
        return int(any(f.code in ("parse", "type") for f in found))
    elif a.command == "describe":
        d = db.describe()
        if a.type:
            d = {k: [x for x in v if x["name"] == a.type] if isinstance(v, list) else v for k, v in d.items()}
        print(json.dumps(d, ensure_ascii=False))
    elif a.command == "export":
        for r in db.export(embeddings=not a.no_embeddings).toLocalIterator():
            print(r.value)
    elif a.command == "changes":
        print(formats.render(feed.window(db.store, since=a.since, first=getattr(a, "from"), last=a.to), a.format or "jsonl"))
    elif a.command == "embed":
        print(json.dumps({"rows": db.embed(a.type, a.property, only_null=not a.all, limit=a.limit, dry_run=a.dry_run)}))
    elif a.command == "compact":
        print(json.dumps(db.compact()))
    elif a.command == "cleanup":
        print(json.dumps(db.cleanup(keep=a.keep, older_than=a.older_than)))
    elif a.command == "doctor":
        problems = db.doctor()
        print("\n".join(problems) or "sound")
        return int(bool(problems))
    elif a.command == "migrate":
        for s in db.migrate(_read(a.schema or config.schema), confirm=a.confirm, dry_run=a.dry_run):
            print(f"{s.kind} {s.target} {s.safety} {s.detail}".rstrip())
    return 0


if __name__ == "__main__":
    sys.exit(main())
