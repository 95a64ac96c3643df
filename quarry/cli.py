"""Command line: index, query, mcp, clear-index, version."""

from __future__ import annotations

import argparse
import json
import os
import sys

from quarry.config import first_set, load_file, state_dir
from quarry.functions.embedding import selected
from quarry.operators.search import DEFAULT_K
from quarry.plans.index import Index
from quarry.session import build_session

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quarry")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("index", "query", "mcp", "clear-index"):
        command = commands.add_parser(name)
        command.add_argument("--dir", default=".")
        if name == "query":
            command.add_argument("--q", required=True)
            command.add_argument("--top_k", type=int, default=0)
    commands.add_parser("version")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    load_file(os.path.join(state_dir(), "config.json"))
    store = first_set("QUARRY_STORE") or os.path.join(state_dir(), "index")
    spark = build_session(master=first_set("QUARRY_MASTER") or None)
    provider, model = selected()
    index = Index(spark, args.dir, store, provider, model)
    if args.command == "index":
        print(index.refresh(), file=sys.stderr)
    elif args.command == "query":
        hits = index.search(args.q, args.top_k if args.top_k > 0 else DEFAULT_K)
        print(json.dumps([r.asDict() for r in hits.collect()], indent=2, ensure_ascii=False))
    elif args.command == "clear-index":
        index.clear()
    else:
        from quarry.rpc import Server
        from quarry.streaming.refresh import watch_tree

        watch = watch_tree(spark, index.root, index.refresh)
        try:
            Server(index, lambda path: Index(spark, path, store, provider, model)).run(sys.stdin.buffer, sys.stdout.buffer)
        finally:
            watch.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
