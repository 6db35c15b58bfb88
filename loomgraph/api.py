"""The engine as one object: index, queries, baselines, audits, lookups and impact of a project."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomgraph import render
from loomgraph.config import Config
from loomgraph.functions.globs import parse_owners
from loomgraph.operators import diff, impact, lookup, paths
from loomgraph.plans import query
from loomgraph.plans.registry import Registry
from loomgraph.schema import SCHEMAS, Tables
from loomgraph.sources import git, scan
from loomgraph.sources.store import Index, IndexResult
from loomgraph.streaming.watch import Watcher


#: What someone who works through tools should know first.
GUIDE = """Structural questions about this project are answered by its index.

* Ask `context` first, with what you are about to do as `intent`; it names recipes that help.
* `query_recipe` runs a recipe, `query` read-only SQL over the tables of the resource `schema`.
* `show` finds a symbol, `snippet` its source; a snippet that is `stale` has changed since it was indexed.
* `impact` tells who is reached from a symbol or file; `summary` leaves out the rows.
* `save_baseline` before a change and `audit` after it show what was added and removed.
"""


class NotFound(KeyError):
    """No recipe or baseline of that name."""

    def __str__(self) -> str:
        return str(self.args[0])


class Project:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, **overrides):
        self.spark = spark
        self.config = config or Config.load(os.path.abspath(root), **overrides)
        self.store = Index(spark, self.config)
        self.registry = Registry(f"{self.config.root}/.loomgraph/recipes")
        self.watcher: Watcher | None = None

    @property
    def root(self) -> str:
        return self.config.root

    @property
    def watching(self) -> bool:
        """Whether a watcher keeps the index current, so that nothing need be indexed before an answer."""
        return self.watcher is not None and self.watcher.active

    def watch(self, on_error: Callable[[Exception], None] = lambda e: None) -> Watcher:
        """Start to keep the index current; stop() of the result ends it."""
        self.watcher = Watcher(self.store, on_error)
        self.watcher.start()
        return self.watcher

    @property
    def tables(self) -> Tables:
        return self.store.tables()

    def index(self, mode: str = "incremental", files: list[str] | None = None, performance: bool = False) -> IndexResult:
        return self.store.build(mode, files, performance)

    # Queries

    def recipe(self, name: str):
        try:
            return self.registry.get(name)
        except KeyError:
            raise NotFound(f"no recipe named {name!r}; there are {', '.join(self.registry.ids())}") from None

    def grouping(self, name: str) -> query.Grouping:
        if name == "directory":
            return query.Grouping(name, paths.by_directory)
        if name == "owner":
            for p in (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS"):
                file = Path(self.root) / p
                if file.exists():
                    return query.Grouping(name, paths.by_owner(parse_owners(file.read_text())), paths.NO_OWNER)
            raise ValueError("group by owner: there is no owners file")
        if name == "package":
            return query.Grouping(name, paths.by_package(workspace_roots(self.root)))
        raise ValueError(f"group by directory, owner or package, not {name!r}")

    def query(self, sql: str | None = None, recipe: str | None = None, params: dict | None = None, changed_since: str | None = None, group_by: str | None = None, summary: bool = False, fmt: str = "json") -> object:
        """An envelope, or text for the other formats."""
        try:
            render.check_format(fmt, summary, bool(group_by))
            chosen = self.recipe(recipe) if recipe else None
            changed = git.changed_files(self.root, changed_since) if changed_since else None
            group = self.grouping(group_by) if group_by else None
        except (ValueError, git.GitError) as e:
            return {"error": str(e)}
        found = query.execute(self.tables, sql, chosen, params, changed, group, summary)
        if chosen and not (isinstance(found, dict) and "error" in found):
            self.store.touch_recipe(chosen.id)
        return found if fmt == "json" or isinstance(found, dict) else self.render(found, fmt, chosen)

    def query_batch(self, statements: list[str | dict], **defaults) -> list:
        out = []
        for s in statements:
            own = {"sql": s} if isinstance(s, str) else dict(s)
            out.append(self.query(**(defaults | own)))
        return out

    def render(self, rows: list[dict], fmt: str, recipe=None) -> str:
        name = recipe.id if recipe else None
        if fmt == "sarif":
            return render.sarif(rows, name, recipe.description if recipe else None)
        if fmt == "annotations":
            return render.annotations(rows)
        if fmt == "mermaid":
            return render.mermaid(rows, name)
        if fmt == "diff":
            return render.unified(rows, self._read)
        if fmt == "diff-json":
            return json.dumps(render.edits(rows, self._read), indent=2)
        return render.text_table(rows) if fmt == "text" else json.dumps(rows, indent=2, default=str)

    def _read(self, path: str) -> str | None:
        try:
            return (Path(self.root) / path).read_text(errors="replace")
        except OSError:
            return None

    def plan(self, sql: str | None = None, recipe: str | None = None, params: dict | None = None) -> DataFrame:
        """The query as a lazy DataFrame."""
        return query.plan_recipe(self.tables, self.recipe(recipe), params) if recipe else query.plan_sql(self.tables, sql or "")

    # Baselines and audits

    def save_baseline(self, name: str | None = None, sql: str | None = None, recipe: str | None = None, params: dict | None = None) -> dict:
        if bool(sql) == bool(recipe):
            raise ValueError("a baseline is of one query: SQL or a recipe")
        name = name or recipe
        if not name:
            raise ValueError("a baseline of SQL needs a name")
        return self.store.save_baseline(name, self.plan(sql, recipe, params), sql or f"recipe {recipe}", recipe)

    def diff_baseline(self, name: str, sql: str | None = None, recipe: str | None = None, params: dict | None = None, summary: bool = False) -> dict:
        found = self.store.baseline(name)
        if found is None:
            raise NotFound(f"no baseline named {name!r}")
        manifest, base = found
        recipe = recipe or (manifest["recipe_id"] if not sql else None)
        current = self.plan(sql or (None if recipe else manifest["sql"]), recipe, params)
        added, removed = diff.diff_rows(base, current)
        head = {k: manifest[k] for k in ("name", "recipe_id", "row_count", "git_ref", "created_at")}
        out = {"baseline": head, "current_row_count": current.count()}
        if summary:
            return out | {"added": added.count(), "removed": removed.count()}
        actions = self.recipe(recipe).actions if recipe else ()
        return out | {"added": query.rows_of(query.with_actions(added, actions)), "removed": query.rows_of(removed)}

    def audit(self, baselines: dict[str, str] | None = None, prefix: str | None = None, base: str | None = None, summary: bool = False, no_index: bool = False) -> dict:
        """What was added and removed since saved baselines, or since a commit."""
        if base and prefix:
            return {"error": "an audit is against a commit or a prefix of baselines, not both"}
        if not no_index and not self.watching:
            self.index("incremental")
        chosen = dict(baselines or {})
        if prefix:
            for d in diff.DELTAS:
                if d.key not in chosen and self.store.baseline(f"{prefix}-{d.key}"):
                    chosen[d.key] = f"{prefix}-{d.key}"
        if not chosen and not base:
            return {"error": "an audit needs a commit, or baselines: " + ", ".join(d.key for d in diff.DELTAS)}
        past = None
        if base:
            try:
                commit, folder = git.snapshot(self.root, base, f"{self.config.index}/snapshots")
            except git.GitError as e:
                return {"error": str(e)}
            past = Project(self.spark, folder, Config.load(folder, index_path=f"{folder}/.loomgraph", include=self.config.include, exclude_dir_names=tuple(x for x in self.config.exclude_dir_names)))
            if not past.store._pointer().get("meta"):
                past.index("full")
        deltas = {}
        for d in diff.DELTAS:
            if d.key in chosen:
                found = self.store.baseline(chosen[d.key])
                if found is None:
                    return {"error": f"no baseline named {chosen[d.key]!r}, wanted for {d.key}"}
                manifest, rows = found
                origin = {"source": "baseline", "name": manifest["name"], "sha": manifest["git_ref"], "indexed_at": manifest["created_at"]}
            elif past is not None:
                rows, origin = d.rows(past.tables), {"source": "ref", "ref": base, "sha": commit, "indexed_at": past.store.meta().get("indexed_at")}
            else:
                continue
            try:
                added, removed = diff.compute_delta(rows, d.rows(self.tables), d)
            except diff.MissingColumns as e:
                return {"error": str(e)}
            if summary:
                deltas[d.key] = {"base": origin, "added": added.count(), "removed": removed.count()}
            else:
                deltas[d.key] = {"base": origin, "added": query.rows_of(added.orderBy(*d.columns)), "removed": query.rows_of(removed.orderBy(*d.columns))}
        return {"head": {"sha": git.head(self.root), "indexed_at": int(time.time() * 1000)}, "deltas": deltas}

    # Lookups

    def relative(self, path: str | None) -> str | None:
        if not path:
            return path
        inside = path.removeprefix(self.root.rstrip("/") + "/")
        return re.sub(r"^(\./)+", "", inside.replace("\\", "/"))

    def show(self, name: str, kind: str | None = None, within: str | None = None) -> dict:
        return lookup.show(self.tables.symbols, name, kind, self.relative(within))

    def snippet(self, name: str, kind: str | None = None, within: str | None = None) -> dict:
        out = self.show(name, kind, within)
        files = sorted({m["file_path"] for m in out["matches"]})
        if files:
            matched = lookup.find_symbols(self.tables.symbols, name, kind, self.relative(within))
            named = self.spark.createDataFrame([(p,) for p in files], "path string")
            rows = lookup.snippets(matched, self.tables.files, scan.hashes_on_disk(self.spark, self.config, named, texts=True)).orderBy("file_path", "line_start")
            out["matches"] = query.rows_of(rows)
        return out

    def validate(self, targets: list[str] | None = None) -> list[dict]:
        named = sorted({self.relative(p) for p in targets or ()})
        frame = self.spark.createDataFrame([(p,) for p in named], "path string") if named else None
        disk = scan.hashes_on_disk(self.spark, self.config, self.tables.files if frame is None else frame)
        return query.rows_of(lookup.validate(self.tables.files, disk, frame))

    def impact(self, target: str, direction: str = "both", via: str = "all", depth: int = impact.DEFAULT_DEPTH, limit: int = impact.DEFAULT_LIMIT, summary: bool = False) -> dict:
        if direction not in ("up", "down", "both") or via not in ("all", "calls", "dependencies", "imports"):
            return {"error": f"direction {direction!r} or via {via!r} isn't known"}
        found = impact.find_impact(self.tables, target, direction, via, depth, limit)
        rows = [] if summary else query.rows_of(found.matches)
        out = {"target": found.target, "direction": direction, "via": found.via, "depth_limit": depth, "matches": rows, "summary": found.summary}
        return out | ({"skipped_backends": found.skipped_backends} if found.skipped_backends else {})

    def context(self, compact: bool = False, intent: str | None = None) -> dict:
        return lookup.context(self.tables, self.root, self.registry.ids(), compact, intent)

    def ingest_coverage(self, path: str, kind: str | None = None) -> dict:
        return self.store.ingest_coverage(path, kind)

    # Resources

    def resource(self, uri: str) -> object:
        """recipes, recipes/<id>, schema, files/<path> or symbols/<name>."""
        head, _, rest = uri.partition("/")
        if head == "recipes":
            listed = self.registry.catalogue(self.store.recency())
            return listed if not rest else next((r for r in listed if r["id"] == self.recipe(rest).id), None)
        if head == "schema":
            return {n: [{"name": f.name, "type": f.dataType.simpleString()} for f in s.fields] for n, s in SCHEMAS.items()}
        if head == "symbols" and rest:
            return self.show(rest)
        if head == "files" and rest:
            t = self.tables
            own = lambda df, c="file_path": query.rows_of(df.where(df[c] == rest).drop("id"))
            from loomgraph.operators.coverage import per_file

            return {"file": own(t.files, "path"), "symbols": own(t.symbols), "imports": own(t.imports), "exports": own(t.exports), "coverage": own(per_file(t.coverage))}
        if head == "guide" and not rest:
            return GUIDE
        raise NotFound(f"no resource {uri!r}")


def workspace_roots(root: str) -> list[str]:
    """Folders of the workspaces that the project's manifests name."""
    patterns: list[str] = []
    try:
        given = json.loads((Path(root) / "package.json").read_text()).get("workspaces", [])
        patterns += given if isinstance(given, list) else given.get("packages", [])
    except (OSError, ValueError, AttributeError):
        pass
    try:
        text = (Path(root) / "pnpm-workspace.yaml").read_text()
        block = re.search(r"^packages:\s*\n((?:\s+-.*\n?)+)", text, re.M)
        patterns += re.findall(r"-\s*['\"]?([^'\"\s]+)", block[1]) if block else []
    except OSError:
        pass
    out = set()
    for p in patterns:
        if not p.startswith("!"):
            out |= {d.relative_to(root).as_posix() for d in Path(root).glob(p.rstrip("/")) if d.is_dir() and "node_modules" not in d.parts}
    return sorted(out, key=lambda r: (-len(r), r))


def as_json(value: object) -> str:
    return json.dumps(asdict(value) if isinstance(value, IndexResult) else value, indent=2, default=str)
