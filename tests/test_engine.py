"""A project from end to end: index, queries, baselines, audits, lookups, coverage, command line, HTTP, tools and watcher."""

import io
import json
import os
import subprocess
import threading
import time
import urllib.error
import urllib.request
from pathlib import Path

import pytest

from loomgraph import cli, mcp, serve
from loomgraph.api import NotFound, Project
from loomgraph.config import Boundary, Config, ConfigError
from loomgraph.plans import guard, query
from loomgraph.sources import git, scan
from loomgraph.sources.extract import adapters
from loomgraph.sources.store import Index
from loomgraph.streaming import watch
from tests.project import make


def sh(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


def commit(root):
    sh(root, "add", "-A")
    sh(root, "commit", "-qm", "state")
    return git.head(root)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    """An indexed project with a commit; the tests that change files make their own."""
    root = make(tmp_path_factory.mktemp("shop"))
    Path(root, ".gitignore").write_text(".loomgraph/\nnode_modules/\n")
    sh(root, "init", "-q")
    commit(root)
    p = Project(spark, root, text_search=True)
    result = p.index("full", performance=True)
    assert result.mode == "full" and result.indexed == result.stats["files"] == 20 and result.slowest
    return p


@pytest.fixture
def small(spark, tmp_path):
    """Three files, committed and indexed."""
    root = tmp_path / "small"
    for path, text in {"a.ts": 'import { b } from "./b";\nexport function a() { return b(); }\n', "b.ts": "export function b() { return 1; }\n", "c.md": "TODO one\n", ".gitignore": ".loomgraph/\n"}.items():
        root.mkdir(exist_ok=True)
        (root / path).write_text(text)
    sh(str(root), "init", "-q")
    commit(str(root))
    p = Project(spark, str(root))
    p.index("full")
    return p


def paths_of(p, recipe=None, **more):
    return [r["path"] for r in p.query("SELECT path FROM files ORDER BY path", **more)]


# Index


def test_the_index_holds_what_extraction_found(project):
    assert paths_of(project)[:3] == [".loomgraph/recipes/by-language.md", "docs/latin.txt.md", "docs/notes.md"]  # of the index's own folder just the recipes
    assert not any("node_modules" in p or p.startswith(".git") for p in paths_of(project))
    got = {(r["from_path"], r["to_path"]) for r in project.query("SELECT * FROM dependencies")}
    assert ("src/steps.ts", "src/types.ts") in got and ("src/chain.ts", "src/steps.ts") in got
    meta = project.store.meta()
    assert meta["last_indexed_commit"] == git.head(project.root) and meta["file_count"] == "20" and meta["text_search"] == "1"
    assert project.query("SELECT count(*) AS n FROM source_fts WHERE token = 'look' AND file_path = 'src/steps.ts'")[0]["n"] == 1


def test_a_tree_read_as_binary_files_gives_the_same(spark, project):
    config = Config(project.root)
    one = scan.parse(spark, config, [p for p in scan.list_files(config) if not p.startswith(".")], now=1).select("path", "content_hash", "size", "line_count", "language", "symbols")
    other = scan.parse_tree(spark, config, now=1).select(*one.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_runs_read_only_what_changed(small):
    root = Path(small.root)
    assert small.index().indexed == 0
    before = {r["path"]: r["indexed_at"] for r in small.query("SELECT path, indexed_at FROM files")}
    (root / "b.ts").write_text("export function b2() { return 1; }\n")
    (root / "d.ts").write_text('import "./a";\n')
    os.remove(root / "c.md")
    run = small.index()
    assert (run.mode, run.indexed) == ("incremental", 2) and paths_of(small) == ["a.ts", "b.ts", "d.ts"]
    after = {r["path"]: r["indexed_at"] for r in small.query("SELECT path, indexed_at FROM files")}
    assert after["a.ts"] == before["a.ts"] and after["b.ts"] > before["b.ts"]
    assert {r["name"] for r in small.query("SELECT name FROM symbols")} == {"a", "b2"} and small.query("SELECT * FROM markers") == []
    assert ("d.ts", "a.ts") in {(r["from_path"], r["to_path"]) for r in small.query("SELECT * FROM dependencies")}
    (root / "a.ts").write_text("export const x = 1;\n")
    (root / "b.ts").write_text("export const y = 1;\n")
    run = small.index(files=["a.ts", "gone.ts"])
    assert (run.mode, run.indexed) == ("files", 1) and {r["name"] for r in small.query("SELECT name FROM symbols")} == {"x", "b2"}
    assert small.index(files=["a.ts"]).skipped == 1  # the same content


def test_rules_follow_the_configuration_on_every_run(spark, small):
    rules = lambda p: sorted(r["name"] for r in p.query("SELECT name FROM boundary_rules"))
    assert rules(small) == []
    ruled = Project(spark, small.root, boundaries=(Boundary("no-b", "a*", "b*"),))
    assert ruled.index().indexed == 0 and rules(ruled) == ["no-b"]  # no file changed
    assert [(r["file_path"], r["to_path"]) for r in ruled.query(recipe="boundaries")] == [("a.ts", "b.ts")]
    small.index()
    assert rules(small) == []


def test_text_search_can_be_turned_on_later(spark, small):
    assert small.query("SELECT count(*) AS n FROM source_fts")[0]["n"] == 0
    on = Project(spark, small.root, text_search=True)
    assert on.index().mode == "full" and on.query("SELECT count(*) AS n FROM source_fts")[0]["n"] > 0


def test_configuration_is_checked(tmp_path):
    for text in ('{"nope": 1}', '{"boundaries": [{"name": "x"}]}', '{"boundaries": [{"name": "x", "from_glob": "a", "to_glob": "b", "action": "ask"}]}'):
        (tmp_path / "loomgraph.config.json").write_text(text)
        with pytest.raises(ConfigError):
            Config.load(str(tmp_path))
    with pytest.raises(ConfigError, match="one name"):
        Config("r", boundaries=(Boundary("a", "x", "y"), Boundary("a", "y", "x")))


def test_adapters_can_be_added_and_replaced(spark, tmp_path):
    (tmp_path / "x.md").write_text("hello\nTODO y\n")
    with pytest.raises(ValueError, match="dots"):
        adapters.register(adapters.Adapter("bad", ("md",), lambda p, t: ({}, None)))
    adapters.register(adapters.Adapter("lines", (".md",), lambda path, text: ({"symbols": [{"name": text.split("\n")[0], "kind": "title", "line_start": 1, "line_end": 1, "is_exported": 0}], "odd": []}, None)))
    try:
        row = scan.parse(spark, Config(str(tmp_path)), ["x.md"]).first()
        assert [s["name"] for s in row["symbols"]] == ["hello"] and row["markers"] == []
    finally:
        adapters.unregister("lines")
    assert scan.facts_of("x.md", "TODO y\n")[0]["markers"][0]["kind"] == "TODO" and scan.facts_of("noending", "x")[1] is None


# Queries


def test_sql_is_answered_or_refused(spark, project):
    assert project.query("SELECT count(*) AS n FROM files")[0]["n"] == 20
    assert project.query("SELECT first_dir('a/b/c') AS d, glob_to_regex('*.ts') AS g") == [{"d": "a", "g": "(?s)^.*\\.ts$"}]
    assert project.query("SELECT path FROM files", summary=True) == {"count": 20}
    for bad in ("DROP TABLE files", "INSERT INTO files SELECT * FROM files", "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit', 0)", "SET x = 1", "SELEC 1", "CREATE TABLE x AS SELECT 1", "SELECT nope FROM files", "SHOW TABLES"):
        assert set(project.query(bad)) == {"error"}, bad
    with pytest.raises(guard.ReadOnlyError):
        guard.check(spark, "CACHE TABLE files", {"files"})
    guard.check(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a WHERE x IN (SELECT 1) UNION ALL SELECT 2", set())


def test_recipes_their_parameters_and_actions(project):
    assert {"deps", "from_path"} == set(project.query(recipe="fan-out")[0])
    assert [r["name"] for r in project.query(recipe="find-symbol-by-kind", params=dict(name_pattern="step%", kind="function"))] == ["stepA", "stepD", "stepB", "stepC"]
    assert project.query(recipe="deprecated")[0]["actions"][0]["type"] == "review-deprecated"
    assert [r["n"] for r in project.query(recipe="by-language", params={"but": "typescript"})][0] == 2
    assert "needs but" in project.query(recipe="by-language")["error"]
    with pytest.raises(NotFound):
        project.query(recipe="none")
    assert project.store.recency()["fan-out"]["run_count"] >= 1
    project.store.touch_recipe("old", now=1)
    project.store.touch_recipe("new")
    assert "old" not in project.store.recency()


def test_the_sql_of_each_recipe_gives_its_rows(spark, project):
    from loomgraph.plans import model
    from loomgraph.plans.recipe_sql import SQL
    from loomgraph.plans.recipes import RECIPES

    t = model.tables(spark, "/root/testdata/sf0.001") if os.path.isdir("/root/testdata/sf0.001") else project.tables
    given = {"find-symbol-by-kind": dict(name_pattern="fn1%", kind="function"), "rename-preview": {"old": "fn10", "new": "fresh", "kind": None, "in_file": "src/d", "include_tests": True, "include_re_exports": True}}
    assert set(SQL) == set(RECIPES)
    for name, sql in SQL.items():
        params = given.get(name, {})
        built = RECIPES[name].build(t, **{k: v for k, v in params.items() if v is not None})
        args = {k: v for k, v in params.items() if f":{k}" in sql}
        shown = query.plan_sql(t, sql, args or None)
        assert shown.columns == built.columns, name
        assert sorted(map(str, shown.collect())) == sorted(map(str, built.collect())), name


def test_groups_changes_batches_and_formats(project):
    found = project.query("SELECT file_path, name FROM symbols", group_by="owner")
    sizes = {g["key"]: g["count"] for g in found["groups"]}
    assert found["group_by"] == "owner" and set(sizes) == {"@core", "@design", "<no-owner>"} and all(len(g["rows"]) == g["count"] for g in found["groups"])
    counts = [g["count"] for g in found["groups"]]
    assert counts == sorted(counts, reverse=True)
    assert {g["key"] for g in project.query("SELECT path FROM files", group_by="package", summary=True)["groups"]} == {"packages/one", "<root>"}
    assert {g["key"] for g in project.query("SELECT path FROM files", group_by="directory", summary=True)["groups"]} >= {"src", "docs"}
    assert "error" in project.query("SELECT path FROM files", group_by="colour")
    assert project.query("SELECT path FROM files", changed_since="HEAD") == [] and "names no commit" in project.query("SELECT path FROM files", changed_since="nope")["error"]
    out = project.query_batch(["SELECT 1 AS x", {"sql": "DROP TABLE x"}, {"recipe": "fan-in", "summary": True}], summary=False)
    assert out[0] == [{"x": 1}] and "error" in out[1] and "count" in out[2]
    assert project.query("SELECT path FROM files LIMIT 1", fmt="sarif").startswith("{") and "error" in project.query("SELECT 1", fmt="sarif", summary=True)
    assert project.query("SELECT path FROM files WHERE path LIKE 'docs/%'", fmt="annotations").count("::notice") == 2
    assert "flowchart" in project.query("SELECT from_path, to_path FROM dependencies", fmt="mermaid")
    preview = project.query(recipe="rename-preview", params={"old": "stepB", "new": "stepZ"}, fmt="diff")
    assert "+export const stepZ" in preview and "+import { stepZ }" in preview
    assert json.loads(project.query(recipe="rename-preview", params={"old": "stepB", "new": "stepZ"}, fmt="diff-json"))["summary"]["hunks"] == 2


# Lookups and impact


def test_show_snippet_and_validate(small):
    one = small.show("a")
    assert [m["file_path"] for m in one["matches"]] == ["a.ts"] and "disambiguation" not in one and small.show("zz") == {"matches": []}
    Path(small.root, "e.ts").write_text("export const a = 2;\n")
    small.index()
    both = small.show("a")
    assert both["disambiguation"]["n"] == 2 and both["disambiguation"]["by_kind"] == {"function": 1, "const": 1}
    assert [m["file_path"] for m in small.show("a", within=f"{small.root}/./e.ts".replace("/./", "/"))["matches"]] == ["e.ts"] and len(small.show("a", "const")["matches"]) == 1
    snip = small.snippet("a", within="a.ts")["matches"][0]
    assert snip["source"] == "export function a() { return b(); }" and not snip["stale"] and not snip["missing"]
    Path(small.root, "a.ts").write_text("changed\n")
    os.remove(Path(small.root, "e.ts"))
    now = {m["file_path"]: (m["stale"], m["missing"], m["source"]) for m in small.snippet("a")["matches"]}
    assert now["a.ts"][:2] == (True, False) and now["e.ts"] == (False, True, None)
    assert small.validate() == [{"path": "a.ts", "status": "stale"}, {"path": "e.ts", "status": "missing"}]
    Path(small.root, "new.md").write_text("x")
    assert small.validate(["new.md", "./b.ts", "nowhere"]) == [{"path": "new.md", "status": "unindexed"}, {"path": "nowhere", "status": "missing"}]


def test_impact_of_symbols_and_files(project):
    down = project.impact("stepA", "down")
    assert [(m["depth"], m["name"]) for m in down["matches"]] == [(1, "stepB"), (2, "stepC"), (3, "far.stepD")]
    assert down["summary"] == {"nodes": 3, "max_depth_reached": 3, "by_kind": {"symbol": 3}, "terminated_by": "depth"} and down["target"]["files"] == ["src/chain.ts"]
    ring = project.impact("ping", "both", depth=0)
    assert {(m["direction"], m["name"]) for m in ring["matches"]} >= {("down", "pong"), ("up", "pong")} and ring["summary"]["terminated_by"] == "exhausted"
    assert all(m["name"] != "ping" for m in ring["matches"])  # a cycle doesn't lead back
    files = project.impact("src/types.ts", "up", depth=2)
    assert {(m["file_path"], m["edge"]) for m in files["matches"]} == {("src/steps.ts", "depended_on_by"), ("src/chain.ts", "depended_on_by")}
    few = project.impact("stepA", "down", limit=1)
    assert len(few["matches"]) == 1 and few["summary"]["terminated_by"] == "limit"
    assert project.impact("stepA", via="imports")["skipped_backends"][0]["backend"] == "imports"
    assert project.impact("stepA", summary=True)["matches"] == [] and "error" in project.impact("stepA", "sideways")
    assert project.impact("unknown-name")["summary"]["nodes"] == 0


def test_a_symbol_of_very_many_files_names_them_all(spark):
    from loomgraph.operators import impact
    from loomgraph.schema import Tables

    symbols = spark.range(700).selectExpr("id", "concat('f', id, '.ts') AS file_path", "'main' AS name", "'function' AS kind")
    t = Tables(spark, {"symbols": symbols})
    assert len(impact.resolve_target(t, "main")["files"]) == 700


def test_walks_beyond_what_is_sent_are_the_same(spark, monkeypatch):
    from loomgraph.operators import impact

    edges = spark.range(60).selectExpr("id AS src", "(id * 7 + 3) % 60 AS dst").union(spark.range(60).selectExpr("id", "(id * 5 + 1) % 60"))
    seeds = spark.createDataFrame([(4,)], "node bigint")
    want = sorted(map(tuple, impact.walk(edges, seeds, 3).collect()))
    monkeypatch.setattr(impact, "SENT_BYTES", 0)
    assert sorted(map(tuple, impact.walk(edges, seeds, 3).collect())) == want and want


def test_context_and_resources(project):
    out = project.context(intent="rename it")
    assert out["project"]["file_count"] == 20 and out["intent"]["classified_as"] == "refactor" and out["hubs"] and out["sample_markers"]
    assert "hubs" not in project.context(compact=True)
    assert {r["id"] for r in project.resource("recipes")} >= {"fan-in", "by-language"} and project.resource("recipes/fan-in")["sql"].startswith("SELECT")
    assert project.resource("schema")["files"][0] == {"name": "path", "type": "string"} and project.resource("symbols/stepA")["matches"]
    file = project.resource("files/src/chain.ts")
    assert file["symbols"][0]["name"] == "stepA" and file["imports"] and file["exports"] and "impact" in project.resource("guide")
    for odd in ("nothing", "recipes/none", "guide/x"):
        with pytest.raises(NotFound):
            project.resource(odd)


# Coverage


def test_coverage_is_attributed_replaced_and_pruned(small, tmp_path):
    (tmp_path / "lcov.info").write_text(f"TN:\nSF:{small.root}/a.ts\nDA:1,1\nDA:2,0\nDA:2,5\nend_of_record\nSF:./b.ts\r\nDA:1,3\r\nDA:x,1\r\nend_of_record\nSF:/elsewhere/z.ts\nDA:1,1\nend_of_record\nSF:never.ts\nDA:1,1\nend_of_record\n")
    found = small.ingest_coverage(str(tmp_path / "lcov.info"))
    assert found == {"ingested": {"symbols": 2, "files": 2}, "skipped": {"unmatched_files": 1, "statements_no_symbol": 1}, "pruned_orphans": 0, "format": "lcov"}
    rows = {r["name"]: (r["coverage_pct"], r["hit_statements"], r["total_statements"]) for r in small.query("SELECT * FROM coverage")}
    assert rows == {"a": (50.0, 1, 2), "b": (100.0, 1, 1)}
    statements = {"x": {"s": {"0": 0}, "path": f"{small.root}/a.ts", "statementMap": dict.fromkeys("01", {"start": {"line": 2}})}}
    (tmp_path / "coverage-final.json").write_text(json.dumps(statements))
    assert small.ingest_coverage(str(tmp_path / "coverage-final.json"))["ingested"] == {"symbols": 1, "files": 1}
    assert {r["name"]: r["coverage_pct"] for r in small.query("SELECT * FROM coverage")} == {"a": 0.0, "b": 100.0}
    os.remove(Path(small.root, "b.ts"))
    small.index()
    assert small.ingest_coverage(str(tmp_path / "coverage-final.json"))["pruned_orphans"] == 1


def test_coverage_of_an_engine_and_kinds(spark, tmp_path):
    from loomgraph.sources import coverage_files as c

    text = "function f() {\n  if (x) {\n    g();\n  }\n}\n\nf();\n"
    at = text.index("{\n    g"), text.index("}\n}") + 1
    functions = [{"functionName": "", "ranges": [{"startOffset": 0, "endOffset": len(text), "count": 1}]}, {"functionName": "f", "ranges": [{"startOffset": 0, "endOffset": text.index("\n\n"), "count": 2}, {"startOffset": at[0], "endOffset": at[1], "count": 0}]}]
    assert c.line_counts(text, functions) == [(1, 2), (2, 0), (3, 0), (4, 0), (5, 2), (6, 1), (7, 1)]
    assert c.line_counts("é🦊\nb", [{"ranges": [{"startOffset": 4, "endOffset": 5, "count": 3}]}]) == [(2, 3)]  # offsets are UTF-16 units
    (tmp_path / "f.js").write_text(text)
    for k, n in ((1, 1), (2, 9)):
        (tmp_path / f"coverage-{k}.json").write_text(json.dumps({"result": [{"url": f"file://{tmp_path}/f.js", "functions": [{"functionName": "", "ranges": [{"startOffset": 0, "endOffset": 5, "count": n}]}]}, {"url": "node:fs", "functions": []}]}))
    rows, kind = c.read(spark, str(tmp_path))
    assert kind == "v8" and [(r.line, r.hit_count) for r in rows.collect()] == [(1, 9)]
    (tmp_path / "lcov.info").write_text("DA:1,1\n")
    with pytest.raises(c.CoverageError, match="and"):
        c.detect(str(tmp_path))
    assert c.detect("x.info") == "lcov" and c.detect("x.json") == "statements"
    with pytest.raises(c.CoverageError):
        c.detect("x.xml")
    for text in ("DA:1,1\n", "SF:a\nend_of_record\nDA:2,1\n", "SF:\nDA:1,1\n"):
        with pytest.raises(Exception, match="outside of a record"):
            c.from_lcov(spark.createDataFrame([(text,)], "value string")).collect()
    many = "SF:a\nDA:1,12345678901234567890123\nDA:2,0\nDA:3\nDA:99999999999,1\nend_of_record\n"
    assert [(r.line, r.hit_count) for r in c.from_lcov(spark.createDataFrame([(many,)], "value string")).collect()] == [(1, (1 << 63) - 1), (2, 0)]


def test_a_hot_file_is_spread_over_cells_of_lines(spark):
    from loomgraph.operators import coverage

    symbols = spark.range(400).selectExpr("id", "'big.ts' AS file_path", "concat('f', id) AS name", "int(id * 10 + 1) AS line_start", "int(id * 10 + if(id % 50 = 0, 600, 9)) AS line_end")
    statements = spark.range(4000).selectExpr("'big.ts' AS file_path", "int(id + 1) AS line", "id % 2 AS hit_count")
    out = coverage.attribute(statements, symbols)
    spans = [(k * 10 + 1, k * 10 + (600 if k % 50 == 0 else 9), f"f{k}") for k in range(400)]
    want: dict = {}
    for line in range(1, 4001):
        if held := [(b - a, a, n) for a, b, n in spans if a <= line <= b]:
            want[min(held)[2]] = want.get(min(held)[2], 0) + 1
    assert {r.name: r.total_statements for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in plan or ">>" in plan


# Baselines and audits


def test_baselines_and_audits(small):
    saved = small.save_baseline(recipe="files-hashes")
    assert saved["name"] == "files-hashes" and saved["row_count"] == 3 and saved["git_ref"] == git.head(small.root)
    small.save_baseline("was-files", "SELECT path FROM files")
    small.save_baseline("bare", "SELECT 1 AS one")
    base = git.head(small.root)
    Path(small.root, "d.ts").write_text('import "./b";\n/** @deprecated */\nexport function old() {}\n')
    os.remove(Path(small.root, "c.md"))
    found = small.audit(prefix="was")
    assert {k: (d["added"], d["removed"]) for k, d in found["deltas"].items()} == {"files": ([{"path": "d.ts"}], [{"path": "c.md"}])}
    changed = small.diff_baseline("files-hashes")
    assert [r["path"] for r in changed["added"]] == ["d.ts"] and [r["path"] for r in changed["removed"]] == ["c.md"] and changed["baseline"]["row_count"] == 3
    assert small.diff_baseline("files-hashes", summary=True)["added"] == 1
    since = small.audit(base=base)
    assert since["deltas"]["deprecated"]["added"] == [{"name": "old", "kind": "function", "file_path": "d.ts"}] and since["deltas"]["files"]["base"]["sha"] == base
    assert since["deltas"]["dependencies"]["added"] == [{"from_path": "d.ts", "to_path": "b.ts"}]
    assert small.audit(base=base, summary=True)["deltas"]["files"] == {"base": since["deltas"]["files"]["base"], "added": 1, "removed": 1}  # the snapshot is cached
    assert "lacks path" in small.audit({"files": "bare"})["error"] and "no baseline" in small.audit({"files": "none"})["error"]
    assert "not both" in small.audit(base=base, prefix="x")["error"] and "needs" in small.audit()["error"] and "error" in small.audit(base="nope")
    assert [b["name"] for b in small.store.baselines()][-1] == "files-hashes" and small.store.drop_baseline("bare") and not small.store.drop_baseline("bare")
    for bad in ("../x", ".hidden", "a/b", ""):
        with pytest.raises(ValueError):
            small.store.save_baseline(bad, small.tables.files, "x")
    with pytest.raises(NotFound):
        small.diff_baseline("none")
    with pytest.raises(ValueError):
        small.save_baseline("x", "SELECT 1", "fan-in")


def test_differences_count_copies_and_shuffle_once(spark):
    from loomgraph.operators import diff

    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, s string")
    b = spark.createDataFrame([("x", 2), ("x", 2), (None, 1)], "s string, k int")
    added, removed = diff.diff_rows(a, b)
    assert [tuple(r) for r in added.collect()] == [("x", 2)] and [tuple(r) for r in removed.collect()] == [(None, 1)]
    assert diff.diff_rows(a, a.limit(0))[1].count() == 3 and diff.diff_rows(a, spark.range(1))[0].columns == ["id"]
    many = spark.range(25_003).selectExpr("'same' AS s", "1 AS k")
    assert diff.diff_rows(b, many)[0].count() == 25_003  # more copies than one block
    plan = diff.diff_rows(a, b)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_audits_read_no_file_while_a_watcher_is_active(small, monkeypatch):
    ran = []
    monkeypatch.setattr(small, "index", lambda *a, **k: ran.append(a))
    small.store.save_baseline("was-files", small.tables.files.select("path"), "x")
    small.audit(prefix="was")
    assert len(ran) == 1 and not small.watching
    small.watcher = watch.Watcher(small.store)
    small.watcher.start(prime=False)
    try:
        assert small.watching
        small.audit(prefix="was")
        assert len(ran) == 1
    finally:
        small.watcher.stop()
    small.audit(prefix="was", no_index=True)
    assert len(ran) == 1 and not small.watching


# Git


def test_changed_files_and_snapshots(tmp_path):
    root = tmp_path / "g"
    root.mkdir()
    sh(str(root), "init", "-q")
    for n in ("one.ts", "two words.ts", "three.ts"):
        (root / n).write_text(n)
    first = commit(str(root))
    (root / "one.ts").write_text("x")
    second = commit(str(root))
    sh(str(root), "mv", "two words.ts", "moved.ts")
    (root / "new.ts").write_text("n")
    assert git.changed_files(str(root), first) == {"one.ts", "two words.ts", "moved.ts", "new.ts"} and git.changed_files(str(root), "HEAD") == {"two words.ts", "moved.ts", "new.ts"}
    assert git.is_ancestor(str(root), first) and not git.is_ancestor(str(root), "0" * 40) and git.head(str(tmp_path)) in (None, git.head(str(tmp_path)))
    with pytest.raises(git.GitError, match="names no commit"):
        git.changed_files(str(root), "nope")
    cache = str(tmp_path / "cache")
    for ref, text in ((first, "one.ts"), (second, "x")):
        sha, folder = git.snapshot(str(root), ref, cache)
        assert sha == ref and Path(folder, "one.ts").read_text() == text
    with pytest.raises(git.GitError):
        git.snapshot(str(root), "nope", cache)


# Command line, HTTP and tools


def run(project, *argv):
    return cli.run(["--root", project.root, *argv], project.spark)


def test_command_line(project, small, tmp_path, monkeypatch):
    assert cli.run(["version"]) == ("0.1.0", 0)
    assert run(project, "query", "SELECT 1 AS x") == ([{"x": 1}], 0) and run(project, "query", "DROP TABLE x")[1] == 1
    assert run(project, "query", "--print-sql", "fan-in")[0].startswith("SELECT to_path") and "no recipe" in run(project, "query", "--print-sql", "zz")[0]["error"]
    assert len(run(project, "query", "--recipes-json")[0]) == 26
    out, code = run(project, "query", "SELECT path FROM files", "--format", "sarif", "--ci")
    assert code == 1 and json.loads(out)["version"] == "2.1.0"
    assert run(project, "query", "SELECT path FROM files", "--format", "annotations", "--ci")[1] == 0
    assert run(project, "query", "SELECT path FROM files WHERE path = 'zz'", "--format", "sarif", "--ci")[1] == 0
    assert run(project, "query", "--recipe", "by-language", "--params", "but=css", "--summary")[0]["count"] > 2
    assert "summary" in run(project, "query", "SELECT 1", "--format", "mermaid", "--summary")[0]["error"]
    assert run(project, "show", "stepA")[1] == 0 and run(project, "show", "zz")[1] == 1
    assert run(project, "impact", "stepA", "--direction", "down", "--depth", "1", "--summary")[0]["summary"]["nodes"] == 1
    assert run(project, "context", "--compact", "--for", "fix it")[0]["intent"]["classified_as"] == "debug"
    monkeypatch.chdir(project.root)
    assert cli.run(["dead-code"], project.spark) == (run(project, "query", "--recipe", "untested-and-dead")[0], 0)
    assert run(small, "query", "SELECT path FROM files", "--save-baseline", "all")[0]["row_count"] == 3
    assert run(small, "query", "--baselines")[0][0]["name"] == "all" and run(small, "query", "--baseline", "all")[0]["added"] == []
    assert run(small, "query", "--drop-baseline", "all")[1] == 0 and run(small, "query", "--drop-baseline", "all")[1] == 1
    base = git.head(small.root)
    Path(small.root, "z.ts").write_text("export const z = 1;\n")
    out, code = run(small, "audit", "--base", base, "--format", "sarif", "--ci")
    assert code == 1 and "new files: z.ts" in out
    (tmp_path / "audit.json").write_text(json.dumps(run(small, "audit", "--base", base)[0]))
    assert "files: added (1)" in cli.run(["pr-comment", str(tmp_path / "audit.json")])[0]
    assert run(small, "validate")[1] == 0
    Path(small.root, "z.ts").write_text("changed")
    assert run(small, "validate")[1] == 1 and run(small, "index", "--files", "z.ts")[0].indexed == 1 and run(small, "audit")[1] == 1


def request(url, body=None, **headers):
    data = None if body is None else json.dumps(body).encode() if not isinstance(body, bytes) else body
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers)) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http(project):
    server = serve.serve(project, port=0, token="secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at, key = f"http://127.0.0.1:{server.server_address[1]}", {"Authorization": "Bearer secret"}
    try:
        assert request(f"{at}/health") == (200, {"ok": True, "version": "0.1.0"})
        assert request(f"{at}/tools")[0] == 401 and request(f"{at}/tools", Authorization="Bearer no")[0] == 401
        assert len(request(f"{at}/tools", **key)[1]["tools"]) == len(serve.TOOLS)
        assert request(f"{at}/tools", **key, Origin="http://evil.example")[0] == 403 and request(f"{at}/tools", **key, Origin=at)[0] == 200
        assert request(f"{at}/tool/query", {"sql": "SELECT 1 AS x"}, **key) == (200, [{"x": 1}])
        assert request(f"{at}/tool/query", {"sql": "DROP TABLE x"}, **key)[0] == 400 and request(f"{at}/tool/query", {}, **key)[0] == 400
        assert request(f"{at}/tool/query", b"{", **key)[0] == 400 and request(f"{at}/tool/none", {}, **key)[0] == 404
        assert request(f"{at}/tool/query_recipe", {"recipe": "none"}, **key)[0] == 404 and request(f"{at}/tool/show", {"name": "stepA", "colour": 1}, **key)[0] == 400
        assert request(f"{at}/tool/show", {"name": "stepA", "in": "src/"}, **key)[1]["matches"][0]["name"] == "stepA"
        assert request(f"{at}/resources/schema", **key)[0] == 200 and request(f"{at}/resources/zz", **key)[0] == 404 and request(f"{at}/zz", **key)[0] == 404
        assert request(f"{at}/tool/query", b"x" * (serve.MAX_BODY + 1), **key)[0] == 413
    finally:
        server.shutdown()
        server.server_close()


def test_tools_over_standard_input(project):
    ask = lambda n, method, **params: json.dumps({"jsonrpc": "2.0", "id": n, "method": method, "params": params})
    lines = [ask(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(2, "tools/list"), ask(3, "tools/call", name="query", arguments={"sql": "SELECT 1 AS x"}), ask(4, "tools/call", name="query", arguments={"sql": "DROP TABLE x"})]
    lines += [ask(5, "tools/call", name="none"), ask(6, "resources/list"), ask(7, "resources/read", uri="loomgraph://schema"), ask(8, "resources/read", uri="loomgraph://zz"), ask(9, "odd"), "{", "[]", "", ask(10, "ping"), ask(11, "resources/templates/list")]
    out = io.StringIO()
    mcp.run(project, [x + "\n" for x in lines], out)
    by = {}
    for x in map(json.loads, out.getvalue().strip().split("\n")):
        by.setdefault(x["id"], []).append(x)
    assert by[1][0]["result"]["serverInfo"]["name"] == "loomgraph" and {t["name"] for t in by[2][0]["result"]["tools"]} == set(serve.TOOLS)
    assert json.loads(by[3][0]["result"]["content"][0]["text"]) == [{"x": 1}] and by[3][0]["result"]["isError"] is False and by[4][0]["result"]["isError"]
    assert [by[n][0]["error"]["code"] for n in (5, 8, 9)] == [-32602, -32002, -32601] and [x["error"]["code"] for x in by[None]] == [-32700, -32600]
    assert len(by[6][0]["result"]["resources"]) == 3 and "files" in json.loads(by[7][0]["result"]["contents"][0]["text"]) and by[10][0]["result"] == {} and len(by[11][0]["result"]["resourceTemplates"]) == 3


# Watching


class Recorder:
    """Stands in for an index: what was rebuilt, and whether two rebuilds ever ran at once."""

    def __init__(self, root):
        self.config, self.runs, self.inside, self.overlap = Config(str(root)), [], 0, False

    def build(self, mode, files=None):
        self.inside += 1
        self.overlap |= self.inside > 1
        time.sleep(0.05)
        self.inside -= 1
        self.runs.append((mode, files))
        if files and "bad.ts" in files:
            raise RuntimeError("can't")


def touched(root) -> bool:
    """Write one more file now and then: a stream sees what comes after its start, which takes a while."""
    time.sleep(0.5)
    (root / f"n{time.monotonic_ns()}.ts").write_text("x")
    return True


def until(test, seconds=20):
    end = time.monotonic() + seconds
    while not test():
        assert time.monotonic() < end
        time.sleep(0.02)


def test_watched_paths():
    yes = ["a.ts", "deep/b.CSS", ".loomgraph/recipes/x.sql", ".loomgraph/recipes/x.md"]
    no = ["a.txt", "node_modules/x/a.ts", "x/node_modules/a.ts", ".loomgraph/other.sql", ".loomgraph/recipes/x.ts.bak"]
    assert all(watch.is_watched(p, ("node_modules",)) for p in yes) and not any(watch.is_watched(p, ("node_modules",)) for p in no)
    assert watch.compare({"a": 1, "b": 1}, {"b": 2, "c": 1}) == [("a", "unlink"), ("b", "change"), ("c", "add")]


def test_bursts_are_rebuilt_one_at_a_time(tmp_path):
    (tmp_path / "a.ts").write_text("1")
    own, errors = Recorder(tmp_path), []
    watcher = watch.Watcher(own, errors.append, quiet_ms=200, poll_ms=20)
    watcher.start()
    assert own.runs == [("incremental", None)] and watcher.active  # current before it is active
    for n in range(4):
        (tmp_path / f"b{n}.ts").write_text("x")
        time.sleep(0.03)
    until(lambda: len(own.runs) == 2)
    assert own.runs[1] == ("files", ["b0.ts", "b1.ts", "b2.ts", "b3.ts"])
    (tmp_path / "bad.ts").write_text("x")
    until(lambda: errors)
    os.remove(tmp_path / "a.ts")
    time.sleep(0.06)
    watcher.stop()  # what waits is done first
    assert own.runs[-1] == ("files", ["a.ts"]) and not own.overlap and not watcher.active and "can't" in str(errors[0])


def test_file_events_stream_and_are_joined(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.ts").write_text("1")
    got: list = []
    stream = watch.events(spark, str(root), ["dist"]).writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.select("path", "event").collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until(lambda: touched(root) and any(e == "add" for _, e in got), 120)
        os.remove(root / "a.ts")
        until(lambda: ("a.ts", "unlink") in got, 120)
    finally:
        stream.stop()
    assert len({p for p, e in got if e == "add"}) == sum(e == "add" for _, e in got)  # each once
    df = spark.createDataFrame([("a", 1.0), ("b", 1.1), ("a", 1.2), ("c", 9.0)], "path string, t double").selectExpr("path", "timestamp_micros(cast(t * 1e6 AS bigint)) AS at")
    joined = watch.debounce(df, "at", "500 milliseconds", path="path").orderBy("began").collect()
    assert [(r.events, r.paths) for r in joined] == [(3, ["a", "b"]), (1, ["c"])]


def test_a_stream_of_events_rebuilds(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.ts").write_text("1")
    own = Recorder(root)
    stream = watch.follow(spark, own, str(tmp_path / "cp"))
    try:
        until(lambda: touched(root) and own.runs, 120)
    finally:
        stream.stop()
    assert all(mode == "files" and paths for mode, paths in own.runs) and not own.overlap


def test_the_shared_folder_is_refused_where_it_would_be_local(spark, monkeypatch):
    from loomgraph import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="all executors"):
        session.shared_dir(Session())
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_the_index_is_written_anew_and_old_snapshots_go(small):
    store: Index = small.store
    folders = lambda: {p.name for p in (store.path / "data" / "files").iterdir()}
    before = folders()
    small.index("full")
    assert len(folders()) == 1 and folders() != before
