"""Renderers, checks of formats, parameters and front matter: no session needed."""

import json

import pytest

from loomgraph import render
from loomgraph.functions.globs import parse_owners
from loomgraph.operators.lookup import classify_intent
from loomgraph.plans.recipes import RECIPES, Param, Recipe
from loomgraph.plans.registry import RecipeError, Registry, bind, first_word, load_project, parse_params, split_front

ROWS = [
    {"file_path": "src/a.ts", "name": "run", "kind": "function", "signature": "run(): void", "line_start": 3, "line_end": 9},
    {"path": "docs/b,c.md", "line_count": 7, "kind": None},
    {"n": 1},
    {"from_path": "x.ts", "to_path": "y.ts"},
    {"file_path": "", "path": None, "to_path": "z.ts", "line_start": 0},
]


def test_places_and_messages():
    assert [render.place_of(r) for r in ROWS] == ["file_path", "path", None, "to_path", "to_path"]
    assert [render.message(r) for r in ROWS] == ["run: run(): void", "line_count=7", "n=1", "(no message)", "(no message)"]
    assert render.message({"name": "x", "kind": "const"}) == "x: const" and render.message({"name": "x"}) == "x"


def test_sarif_has_rows_with_a_place():
    run = json.loads(render.sarif(ROWS, "fan-in", "Users", "Long text"))["runs"][0]
    assert run["tool"]["driver"]["rules"][0]["id"] == "loomgraph.fan-in" and run["tool"]["driver"]["rules"][0]["fullDescription"]["text"] == "Long text"
    assert len(run["results"]) == 4 and {r["level"] for r in run["results"]} == {"note"}
    first = run["results"][0]["locations"][0]["physicalLocation"]
    assert first == {"artifactLocation": {"uri": "src/a.ts"}, "region": {"startLine": 3, "endLine": 9}}
    assert "region" not in run["results"][3]["locations"][0]["physicalLocation"]  # line 0 is none
    assert json.loads(render.sarif([]))["runs"][0]["results"] == []
    assert json.loads(render.sarif([]))["runs"][0]["tool"]["driver"]["rules"][0]["id"] == "loomgraph.adhoc"


def test_sarif_of_an_audit_warns_of_what_was_added():
    run = json.loads(render.audit_sarif({"files": [{"path": "new.ts"}], "deprecated": []}))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["loomgraph.audit.files-added", "loomgraph.audit.deprecated-added"]
    assert [(r["level"], r["message"]["text"]) for r in run["results"]] == [("warning", "new files: new.ts")]


def test_annotations_escape_what_ends_a_command():
    out = render.annotations([*ROWS, {"path": "a:b.ts", "name": "50%\nmore"}]).split("\n")
    assert out[0] == "::notice file=src/a.ts,line=3,endLine=9::run: run(): void"
    assert out[1].startswith("::notice file=docs/b%2Cc.md::") and len(out) == 5
    assert out[4] == "::notice file=a%3Ab.ts::50%25%0Amore"


def test_flowcharts():
    rows = [{"from_path": "a", "to_path": "b"}, {"from": "b", "to": 'c "q"', "label": "calls"}, {"from": "a"}, {"from_path": "a", "to_path": "b"}]
    out = render.mermaid(rows).split("\n")
    assert out[0] == "flowchart LR" and sum("-->" in x for x in out) == 3 and sum("[" in x for x in out) == 3
    assert '  n1 -->|"calls"| n2' in out and '  n2["c #quot;q#quot;"]' in out
    with pytest.raises(render.FormatError, match="51 edges"):
        render.mermaid([{"from": "a", "to": "b"}] * 51, "x")
    assert render.mermaid([]) == "flowchart LR"


FILES = {"a.ts": "let old = old2;\nkeep\nold();\n", "b.ts": "nothing\n"}


def edit(path, line, before="old", after="fresh"):
    return {"file_path": path, "line_start": line, "before_pattern": before, "after_pattern": after}


def test_edits_replace_once_and_tell_stale_and_missing_files():
    rows = [edit("a.ts", 1), edit("a.ts", 1), edit("a.ts", 3), edit("a.ts", 99), edit("b.ts", 1), edit("gone.ts", 1), {"file_path": "a.ts"}]
    found = render.edits(rows, FILES.get)
    assert found["summary"] == {"files": 3, "hunks": 2, "missing": 1, "stale": 2}
    assert [x["text"] for x in found["files"][0]["hunks"][0]["lines"]] == ["let old = old2;", "let fresh = fresh2;"]  # two rows, two occurrences
    text = render.unified(rows, FILES.get).split("\n")
    assert text[:4] == ["# stale: a.ts", "--- a/a.ts", "+++ b/a.ts", "@@ -1,1 +1,1 @@"] and "+fresh();" in text and "# missing: gone.ts" in text
    assert render.unified([edit("a.ts", 1, "old2", "$1\\0")], FILES.get).split("\n")[-1] == "+let old = $1\\0;"  # plain text, no pattern
    assert render.unified([], FILES.get) == ""


def test_text_tables():
    assert render.text_table([]) == "(no rows)"
    assert render.text_table([{"a": 1, "bb": None}, {"a": 22, "bb": "x"}]).split("\n") == ["a   bb", "--  --", "1", "22  x"]


def test_review_comments():
    audit = {"deltas": {"files": {"added": [{"path": f"f{i}|x.ts"} for i in range(60)], "removed": []}}}
    out = render.comment(audit)
    assert "files: added (60)" in out and "f0\\|x.ts" in out and "and 10 more" in out and "removed" not in out
    assert "No structural changes." in render.comment({"deltas": {"files": {"added": [], "removed": []}}})
    assert "loomgraph.fan-in (4)" in render.comment(json.loads(render.sarif(ROWS, "fan-in")))
    assert "No findings." in render.comment(json.loads(render.sarif([])))
    with pytest.raises(render.FormatError):
        render.comment({"rows": []})


def test_exit_codes():
    assert render.exit_code("sarif", [{}]) == 1 and render.exit_code("sarif", []) == 0
    assert render.exit_code("annotations", [{}]) == 0 and render.exit_code("json", [{}]) == 0  # they only inform
    assert render.exit_code("json", audit={"deltas": {"files": {"added": [1]}}}) == 1
    assert render.exit_code("json", audit={"deltas": {"files": {"added": [], "removed": [1]}}}) == 0


@pytest.mark.parametrize("fmt", sorted(set(render.FORMATS) - {"json", "text"}))
@pytest.mark.parametrize("option", ["summary", "grouped", "baseline"])
def test_formats_of_rows_refuse_what_has_none(fmt, option):
    with pytest.raises(render.FormatError, match=fmt):
        render.check_format(fmt, **{option: True})
    render.check_format(fmt)
    render.check_format("json", **{option: True})


def test_an_unknown_format_is_refused():
    with pytest.raises(render.FormatError, match="none of"):
        render.check_format("yaml")


def test_front_matter_and_first_words():
    assert split_front("---\na: 1\n---\nbody") == ({"a": 1}, "body") and split_front("plain") == ({}, "plain") and split_front("---\n- x\n---\n") == ({}, "")
    with pytest.raises(RecipeError):
        split_front("---\na: [\n---\n")
    assert [first_word(x) for x in ("-- c\n/* d */ SELECT 1", "", "(select 1)", "delete from x")] == ["select", "", "", "delete"]


def test_parameters_are_parsed_and_bound():
    assert parse_params("a=1,b=x=y") == {"a": "1", "b": "x=y"} and parse_params(["a=1", "b="]) == {"a": "1", "b": ""}
    for bad in ("a", "=1", "a=1,b"):
        with pytest.raises(RecipeError):
            parse_params(bad)
    r = Recipe("r", "", None, (Param("s"), Param("n", "number", False, 2), Param("b", "boolean", False)))
    assert bind(r, {"s": 5}) == {"s": "5", "n": 2, "b": None}
    assert bind(r, {"s": "x", "n": "1.5", "b": "TRUE"}) == {"s": "x", "n": 1.5, "b": True}
    for bad, why in (({}, "needs s"), ({"s": 1, "z": 1}, "no parameter z"), ({"s": 1, "n": "nan"}, "no number"), ({"s": 1, "n": True}, "no number"), ({"s": 1, "b": "maybe"}, "neither")):
        with pytest.raises(RecipeError, match=why):
            bind(r, bad)


def test_project_recipes_shadow_and_are_checked(tmp_path):
    (tmp_path / "fan-in.sql").write_text("SELECT 1 AS own;")
    (tmp_path / "mine.sql").write_text("-- note\nSELECT :a AS a")
    (tmp_path / "mine.md").write_text("---\nparams:\n  - {name: a, type: number, required: false, default: 3}\nactions:\n  - {type: look}\n---\n# My own\n")
    own = Registry(str(tmp_path))
    entry = {r["id"]: r for r in own.catalogue({"mine": {"last_run_at": 5, "run_count": 2}})}
    assert entry["fan-in"]["shadows"] and entry["fan-in"]["source"] == "project" and own.get("fan-in").sql == "SELECT 1 AS own"
    assert entry["mine"]["description"] == "My own" and entry["mine"]["params"][0]["default"] == 3 and entry["mine"]["actions"][0]["auto_fixable"] is False
    assert (entry["mine"]["last_run_at"], entry["mine"]["run_count"], entry["fan-out"]["run_count"]) == (5, 2, 0)
    assert own.get("hotspots") is own.get("fan-in") and Registry().get("dead-code").id == "untested-and-dead"
    with pytest.raises(KeyError):
        own.get("none-such")
    for text in ("", "-- only\n", "DROP TABLE x", "pragma x"):
        (tmp_path / "bad.sql").write_text(text)
        with pytest.raises(RecipeError):
            load_project(str(tmp_path))
    (tmp_path / "bad.sql").write_text("SELECT 1")
    (tmp_path / "bad.md").write_text("---\nparams:\n  - {name: a, type: date}\n---\n")
    with pytest.raises(RecipeError, match="date"):
        load_project(str(tmp_path))


def test_every_recipe_shows_its_sql():
    assert all(r["sql"].lower().startswith(("select", "with")) for r in Registry().catalogue()) and len(RECIPES) == 24


def test_intents():
    want = {"Rename the store": "refactor", "please MOVE it": "refactor", "a movement": "other", "fix the crash": "debug", "more coverage": "test", "a new feature": "feature", "read along": "explore", "hm": "other"}
    assert {t: classify_intent(t)["classified_as"] for t in want} == want
    assert all(classify_intent(t)["hint"] and set(classify_intent(t)["matched_recipes"]) <= set(RECIPES) for t in want)


def test_owner_rules():
    rules = parse_owners("# no\n*.ts @a @b\n/docs/ @d # why\nnobody\n")
    assert [(r.pattern, r.owners) for r in rules] == [("*.ts", ("@a", "@b")), ("/docs/", ("@d",))]
