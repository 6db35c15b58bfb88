"""Command line: `python -m loomgraph.cli <verb>`; without a verb it indexes."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from loomgraph import render
from loomgraph.api import NotFound, Project, as_json
from loomgraph.plans.recipes import ALIASES
from loomgraph.plans.registry import RecipeError, parse_params


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog=render.TOOL)
    top.add_argument("--root", default=".")
    top.add_argument("--config")
    verbs = top.add_subparsers(dest="verb")
    index = verbs.add_parser("index")
    index.add_argument("--full", action="store_true")
    index.add_argument("--files", nargs="+")
    index.add_argument("--performance", action="store_true")
    q = verbs.add_parser("query")
    q.add_argument("sql", nargs="?")
    q.add_argument("--recipe")
    q.add_argument("--params", action="append", default=[])
    q.add_argument("--format", default="json", choices=render.FORMATS)
    for flag in ("ci", "summary", "baselines", "recipes-json"):
        q.add_argument(f"--{flag}", action="store_true")
    q.add_argument("--changed-since")
    q.add_argument("--group-by", choices=("directory", "owner", "package"))
    q.add_argument("--save-baseline", nargs="?", const="")
    q.add_argument("--baseline", nargs="?", const="")
    q.add_argument("--drop-baseline")
    q.add_argument("--print-sql")
    audit = verbs.add_parser("audit")
    audit.add_argument("--base")
    audit.add_argument("--baseline", dest="prefix")
    for key in ("files", "dependencies", "deprecated"):
        audit.add_argument(f"--{key}-baseline")
    for flag in ("summary", "no-index", "ci"):
        audit.add_argument(f"--{flag}", action="store_true")
    audit.add_argument("--format", default="json", choices=("json", "sarif"))
    context = verbs.add_parser("context")
    context.add_argument("--compact", action="store_true")
    context.add_argument("--for", dest="intent")
    verbs.add_parser("validate").add_argument("paths", nargs="*")
    for verb in ("show", "snippet"):
        one = verbs.add_parser(verb)
        one.add_argument("name")
        one.add_argument("--kind")
        one.add_argument("--in", dest="within")
    impact = verbs.add_parser("impact")
    impact.add_argument("target")
    impact.add_argument("--direction", default="both", choices=("up", "down", "both"))
    impact.add_argument("--via", default="all", choices=("all", "calls", "dependencies", "imports"))
    impact.add_argument("--depth", type=int, default=3)
    impact.add_argument("--limit", type=int, default=500)
    impact.add_argument("--summary", action="store_true")
    ingest = verbs.add_parser("ingest-coverage")
    ingest.add_argument("path")
    ingest.add_argument("--format", choices=("statements", "lcov", "v8"))
    verbs.add_parser("pr-comment").add_argument("path", help="an audit or SARIF document; - reads standard input")
    verbs.add_parser("watch")
    serve = verbs.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=7878)
    serve.add_argument("--token")
    serve.add_argument("--watch", action="store_true", help="keep the index current meanwhile")
    verbs.add_parser("mcp", help="the tools for a model's client, over standard input and output").add_argument("--watch", action="store_true")
    verbs.add_parser("version")
    return top


def _query(project: Project, a: argparse.Namespace) -> tuple[object, int]:
    if a.recipes_json:
        return project.registry.catalogue(project.store.recency()), 0
    if a.print_sql:
        r = project.recipe(a.print_sql)
        return r.sql or r.shown, 0
    if a.baselines:
        return project.store.baselines(), 0
    if a.drop_baseline:
        gone = project.store.drop_baseline(a.drop_baseline)
        return {"dropped": a.drop_baseline} if gone else {"error": f"no baseline named {a.drop_baseline!r}"}, int(not gone)
    params = parse_params(a.params) if a.params else None
    render.check_format(a.format, a.summary, bool(a.group_by), a.baseline is not None)
    if a.save_baseline is not None:
        return project.save_baseline(a.save_baseline or None, a.sql, a.recipe, params), 0
    if a.baseline is not None:
        return project.diff_baseline(a.baseline or a.recipe, a.sql, a.recipe, params, a.summary), 0
    found = project.query(a.sql, a.recipe, params, a.changed_since, a.group_by, a.summary)
    if isinstance(found, dict) and "error" in found:
        return found, 1
    code = render.exit_code(a.format, found if isinstance(found, list) else None) if a.ci else 0
    return (project.render(found, a.format, project.recipe(a.recipe) if a.recipe else None) if a.format != "json" and isinstance(found, list) else found), code


def run(argv: list[str], spark: SparkSession | None = None) -> tuple[object, int]:
    """(what to print, exit code)."""
    if argv and argv[0] in ALIASES:
        argv = ["query", "--recipe", ALIASES[argv[0]], *argv[1:]]
    a = parser().parse_args(argv)
    if a.verb == "version":
        return render.VERSION, 0
    if a.verb == "pr-comment":
        text = sys.stdin.read() if a.path == "-" else open(a.path).read()
        return render.comment(json.loads(text)), 0
    from loomgraph.config import Config

    spark = spark or SparkSession.builder.appName(render.TOOL).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    root = os.path.abspath(a.root)  # the JVM may be in another folder
    project = Project(spark, root, Config.load(root, a.config))
    try:
        if a.verb in (None, "index"):
            return project.index("full" if a.verb and a.full else "incremental", a.files if a.verb else None, bool(a.verb and a.performance)), 0
        if a.verb == "query":
            return _query(project, a)
        if a.verb == "audit":
            chosen = {k: v for k in ("files", "dependencies", "deprecated") if (v := getattr(a, f"{k}_baseline"))}
            found = project.audit(chosen, a.prefix, a.base, a.summary and a.format == "json", a.no_index)
            if "error" in found:
                return found, 1
            code = render.exit_code(a.format, audit=found) if a.ci and not a.summary else 0
            return (render.audit_sarif({k: d["added"] for k, d in found["deltas"].items()}) if a.format == "sarif" else found), code
        if a.verb == "context":
            return project.context(a.compact, a.intent), 0
        if a.verb == "validate":
            rows = project.validate(a.paths)
            return rows, int(bool(rows))
        if a.verb in ("show", "snippet"):
            found = getattr(project, a.verb)(a.name, a.kind, a.within)
            return found, int(not found["matches"])
        if a.verb == "impact":
            return project.impact(a.target, a.direction, a.via, a.depth, a.limit, a.summary), 0
        if a.verb == "ingest-coverage":
            return project.ingest_coverage(a.path, a.format), 0
        if a.verb in ("serve", "mcp") and a.watch:
            project.watch(lambda e: print(e, file=sys.stderr))
        if a.verb == "mcp":
            from loomgraph.mcp import run as run_mcp

            run_mcp(project, sys.stdin, sys.stdout)
        if a.verb == "serve":
            from loomgraph.serve import serve

            serve(project, a.host, a.port, a.token).serve_forever()
        if a.verb == "watch":
            watcher = project.watch(lambda e: print(e, file=sys.stderr))
            try:
                while True:
                    time.sleep(1)
            except KeyboardInterrupt:
                watcher.stop()
        return None, 0
    except (NotFound, RecipeError, render.FormatError, ValueError) as e:
        return {"error": str(e)}, 1


def main() -> None:
    out, code = run(sys.argv[1:])
    if out is not None:
        print(out if isinstance(out, str) else as_json(out))
    sys.exit(code)


if __name__ == "__main__":
    main()
