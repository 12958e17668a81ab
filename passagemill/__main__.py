"""Commands: sync, ingest, ingest-text, ingest-url, query, read, read-neighbors, list, status, delete."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from passagemill.config import ConfigError, load_config
from passagemill.engine import Engine, result_columns


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="passagemill")
    top.add_argument("--base-dir", action="append", default=[])
    top.add_argument("--index")
    sub = top.add_subparsers(dest="command", required=True)
    for name, args in {"sync": ["path?"], "ingest": ["path"], "query": ["text"], "read": ["source"], "read-neighbors": ["source", "chunk"], "list": ["path?"], "status": [], "delete": ["source"], "ingest-text": ["source"], "ingest-url": ["url"]}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
        if name == "query":
            p.add_argument("--top-k", type=int, default=8)
            p.add_argument("--scope", action="append")
        if name == "ingest-url":
            p.add_argument("--title")
        if name == "read-neighbors":
            p.add_argument("--before", type=int, default=1)
            p.add_argument("--after", type=int, default=1)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        config = load_config(os.environ, a.base_dir, a.index)
    except ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    engine = Engine(SparkSession.builder.getOrCreate(), config)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731 - results are bounded by top_k or one source
    if a.command == "sync":
        counts, errors = engine.sync(a.path)
        out: object = {"counts": counts, "errors": errors}
    elif a.command == "ingest":
        out = {"ingested": engine.ingest_file(os.path.abspath(a.path))}
    elif a.command == "ingest-text":
        out = {"ingested": engine.ingest_data(sys.stdin.read(), a.source, "markdown")}
    elif a.command == "ingest-url":
        out = {"ingested": engine.ingest_url(a.url, title=a.title)}
    elif a.command == "query":
        out = rows(engine.query(a.text, a.top_k, a.scope).orderBy("place").select(*result_columns()))
    elif a.command == "read":
        out = engine.read_document(a.source)
    elif a.command == "read-neighbors":
        out = rows(engine.read_neighbours(a.source, int(a.chunk), a.before, a.after))
    elif a.command == "list":
        print("[", end="")
        for n, r in enumerate(engine.list_files(a.path).toLocalIterator()):  # as many as there are files: never gathered
            print(",\n" if n else "\n", json.dumps(r.asDict(), ensure_ascii=False), sep="", end="")
        out = "\n]"
    elif a.command == "status":
        out = engine.status()
    else:
        out = {"deleted": engine.delete(a.source)}
    print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=2))
    return 1 if a.command == "sync" and out["counts"]["failed"] else 0  # type: ignore[index]


if __name__ == "__main__":
    sys.exit(main())
