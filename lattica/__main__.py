"""The command line: python -m lattica [COMMAND] PATH ..."""

from __future__ import annotations

import argparse
import json
import os
import queue
import sys

from . import engine as E


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattica", description="Structural indexes of source trees, on Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=text, description=text)
        s.add_argument("path", nargs="?", default=".")
        s.add_argument("-l", "--languages", help="names, separated by commas; unknown ones are passed over")
        s.add_argument("--max-file-size", type=int, default=512, help="in KB")
        s.add_argument("--max-depth", type=int)
        s.add_argument("-e", "--exclude", action="append", default=[])
        s.add_argument("--no-gitignore", action="store_true")
        s.add_argument("--cache", help="a folder for the index cache")
        s.add_argument("--wiki", help="the wiki's folder")
        s.add_argument("--filter-path")
        s.add_argument("-o", "--output", help="a file; without one the answer is printed")
        return s

    i = add("index", "Writes the index.")
    i.add_argument("-f", "--format", choices=["markdown", "json", "yaml"], default="markdown")
    i.add_argument("-d", "--detail", choices=["summary", "signatures", "full"], default="signatures")
    i.add_argument("--kind", action="append", default=[])
    i.add_argument("--public-only", action="store_true")
    i.add_argument("--symbol")
    i.add_argument("--max-tokens", type=int)
    i.add_argument("--stats", action="store_true", help="only counts")
    d = add("diff", "Says what commits did to declarations.")
    d.add_argument("--since")
    d.add_argument("--pr", type=int)
    d.add_argument("-f", "--format", choices=["markdown", "json"], default="markdown")
    h = add("hotspots", "Lists the most complex functions.")
    h.add_argument("--limit", type=int, default=30)
    h.add_argument("--min-complexity", type=int, default=1)
    h.add_argument("--sort", default="score")
    add("health", "Aggregates of the tree.")
    g = add("graph", "Draws dependencies.")
    g.add_argument("-f", "--format", choices=["dot", "mermaid", "json"], default="mermaid")
    g.add_argument("--level", choices=["file", "symbol"], default="file")
    g.add_argument("--scope")
    g.add_argument("--depth", type=int)
    q = add("call", "Calls a tool by name.")
    q.add_argument("tool")
    q.add_argument("arguments", nargs="?", default="{}", help="a JSON object")
    s = add("serve", "Answers requests.")
    s.add_argument("--http", type=int, help="a port; without it, lines of standard input")
    s.add_argument("--watch", action="store_true")
    s.add_argument("--debounce", type=int, default=300)
    s.add_argument("--all-tools", action="store_true")
    return p


def engine(a: argparse.Namespace) -> E.Engine:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lattica").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    options = {"respect_gitignore": not a.no_gitignore, "max_kb": a.max_file_size, "max_depth": a.max_depth, "excludes": tuple(a.exclude)}
    return E.Engine(spark, os.path.abspath(a.path), [x for x in (a.languages or "").split(",") if x], options, a.cache, a.wiki)


def answer(e: E.Engine, a: argparse.Namespace):
    """The lines that a command gives."""
    from pyspark.sql import functions as F

    from .operators import budget, trees
    from .sinks import markdown, serialize
    from .sources.extract import KINDS

    if a.command == "index":
        kinds = [k for x in a.kind if (k := KINDS.get(x.lower()))]
        files, decls, imports = trees.filter_index(e.files, e.decls, e.imports, a.filter_path, kinds or None, a.public_only, a.symbol)
        name = os.path.basename(e.root)
        if a.stats:
            return [json.dumps(r.asDict()) for r in trees.stats(files).orderBy("member", "language").collect()]
        if a.max_tokens is not None:
            ix, _ = budget.fitted(budget.Index(name, files, decls, imports, trees.tree_entries(files)), a.max_tokens)
            files, decls, imports = ix.files, ix.decls, ix.imports
        if a.format == "markdown":
            return markdown.workspace(name, files, decls, imports, e.built_at, a.detail)
        return (serialize.json_lines if a.format == "json" else serialize.yaml_lines)(files, decls, imports, name, e.built_at)
    if a.command == "diff":
        out = E.call(e, "get_diff_summary", {"since_ref": a.since, "pr": a.pr, "format": a.format})
        return [out if isinstance(out, str) else json.dumps(out, ensure_ascii=False)]
    if a.command == "hotspots":
        m = e.metrics(e.decls, a.filter_path)
        from .operators import health

        return [json.dumps(r.asDict()) for r in health.hotspots(m, a.limit, a.min_complexity, a.sort).select("file", "name", "line", "cyclomatic", "nesting", "params", "body_lines", F.round("score", 2).alias("score")).collect()]
    if a.command == "health":
        return [json.dumps(E.call(e, "get_health", {"path": a.filter_path}))]
    if a.command == "graph":
        return [E.call(e, "get_dependency_graph", {"level": a.level, "scope": a.scope, "depth": a.depth, "format": a.format})]
    out = E.call(e, a.tool, json.loads(a.arguments))
    return [out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, default=str)]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    e = engine(a)
    if a.command == "serve":
        from .serving import http, protocol
        from .streaming.watch import Poller

        server, changes = protocol.Server(e, a.all_tools), queue.Queue()
        httpd = http.make(server, port=a.http) if a.http is not None else None

        def changed(paths: list[str]) -> None:
            if httpd is None:
                changes.put(("change", paths))
            else:
                with server.lock:
                    e.build()
                httpd.broadcast.say({"jsonrpc": "2.0", "method": "notifications/resources/updated", "params": {"paths": paths}})

        watcher = Poller(e.root, changed, a.debounce, output=a.output) if a.watch else None
        if watcher:
            watcher.start()
        if httpd is not None:
            print(f"listening on port {httpd.server_port}", file=sys.stderr)
            httpd.serve_forever()
        else:
            protocol.serve_lines(server, sys.stdin, sys.stdout, changes, e.build)
        return 0
    try:
        lines = answer(e, a)
        if a.output:
            from .sinks.rows import save

            save(a.output, iter(lines))
        else:
            for x in lines:
                print(x)
    except E.ToolError as x:
        print(x, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
