"""Extractors on inline sources."""

import json

import pytest

from loomgraph.functions.globs import glob_to_regex, owner_glob_to_regex, parse_owners
from loomgraph.functions.words import stem, tokens
from loomgraph.sources.extract import css, tsjs
from loomgraph.sources.extract.lexer import SyntaxProblem
from loomgraph.sources.resolve import candidates
from loomgraph.sources.text_facts import find_markers, find_suppressions
from tests.project import FILES


def facts(path):
    return tsjs.extract(FILES[path], "." + path.rsplit(".", 1)[1])


def by_name(rows):
    return {r["name"]: r for r in rows}


def test_functions_scopes_and_calls():
    f = facts("src/chain.ts")
    a = by_name(f["symbols"])["stepA"]
    assert (a["kind"], a["line_start"], a["line_end"], a["signature"], a["is_exported"], a["doc_comment"], a["complexity"]) == ("function", 3, 5, "stepA(n): number", 1, "Starts it all.", 1.0)
    assert f["calls"] == [{"caller_name": "stepA", "caller_scope": "stepA", "callee_name": "stepB"}]


def test_arrow_constants_literals_and_renamed_exports():
    f = facts("src/steps.ts")
    s = by_name(f["symbols"])
    assert s["stepB"]["kind"] == "function" and s["stepB"]["signature"] == "stepB(n): number"
    assert s["LIMIT"]["value"] == "-3" and s["LIMIT"]["signature"] == "const LIMIT"
    assert s["stepC"]["is_exported"] == 0  # only the new name is exported
    assert [c["callee_name"] for c in f["calls"]] == ["stepC", "far.stepD"]
    assert {e["name"] for e in f["exports"]} == {"stepB", "LIMIT", "renamed"}
    assert [(i["specifiers"], i["is_type_only"]) for i in f["imports"]] == [('["Options"]', 1), ('["* as far"]', 0)]


def test_complexity_and_signature_forms():
    d = by_name(facts("src/far.ts")["symbols"])["stepD"]
    assert d["signature"] == "stepD(n, ..., rest): Promise<Map<string, number>>"
    # 1, if, &&, ||, for, two cases, ?:, ??, while, catch, do
    assert d["complexity"] == 12.0
    assert d["visibility"] == "internal" and "@deprecated" in d["doc_comment"]


def test_types_and_enums():
    f = facts("src/types.ts")
    s = by_name(f["symbols"])
    assert s["Options"]["signature"] == "interface Options<T = string> extends Base"
    assert s["Pair"]["signature"] == "type Pair<A extends string, B>"
    assert json.loads(s["Colour"]["members"]) == [{"name": "Red"}, {"name": "Green", "value": 2}, {"name": "Blue", "value": "b"}]
    m = {(x["symbol_name"], x["name"]): x for x in f["type_members"]}
    assert m["Options", "id"]["is_readonly"] == 1 and m["Options", "name"]["is_optional"] == 1
    assert m["Options", "name"]["type"] == "string | null"
    assert m["Options", "run"]["type"] == "(a, b) => Promise<void>"
    assert m["Shape", "area"]["type"] == "number"
    assert {e["name"]: e["kind"] for e in f["exports"]} == {"Options": "type", "Shape": "type", "Pair": "type", "Colour": "value"}


def test_components_need_elements_or_hooks():
    f = facts("src/ui/Button.tsx")
    assert f["components"] == [{"name": "Button", "props_type": "ButtonProps", "hooks_used": '["useState"]', "is_default_export": 0}]
    assert [i["specifiers"] for i in f["imports"]] == ['["useState"]', '["Frame as Box"]']
    g = facts("src/ui/Frame.tsx")["components"]
    assert [(c["name"], c["props_type"], c["hooks_used"], c["is_default_export"]) for c in g] == [("Frame", "FrameProps", '["useTrack"]', 1)]


def test_reexports():
    e = facts("src/ui/index.ts")["exports"]
    assert [(x["name"], x["kind"], x["re_export_source"]) for x in e] == [("Button", "re-export", "./Button"), ("Frame", "re-export", "./Frame"), ("unknown", "re-export", "./more")]


def test_classes():
    f = facts("src/model.ts")
    shown = [(s["kind"], s["signature"], s["parent_name"]) for s in f["symbols"]]
    assert shown[:7] == [
        ("class", "class Store<T> extends Map<string, T> implements Disposable", None), ("property", "private static count", "Store"), ("property", "readonly size2: number", "Store"),
        ("method", "constructor(...)", "Store"), ("method", "async load(): Promise<void>", "Store"), ("getter", "total()", "Store"), ("setter", "total(v)", "Store"),
    ]
    assert {(c["caller_scope"], c["callee_name"]) for c in f["calls"]} == {("Store.constructor", "this.load"), ("Store.load", "fetchAll")}
    assert all(s["complexity"] is None for s in f["symbols"])


@pytest.mark.parametrize("source", ["export const a = (;", "const s = 'open", "/* open", "function ("])
def test_unreadable(source):
    with pytest.raises(SyntaxProblem):
        tsjs.extract(source, ".ts")


@pytest.mark.parametrize(
    ("source", "names"),
    [
        ("const a = 1\nconst b = a / 2 / a\n", ["a", "b"]),
        ("const r = /[/'\"]+/g.test(x) ? `t${a ? `u` : 'v'}` : 2;\nfunction f() {}", ["r", "f"]),
        ("const o = { function: 1, class: 2, if: 3, get x() { return 1 }, m() { return 2 } };\nlet z", ["o", "z"]),
        ("for (const [k, v] of m) { let w = k; }\nlabel: for (;;) break label;\nexport default async () => {};", ["w"]),
        ("const f = <T,>(x: T): x is string => x as unknown as string\nconst g = async x => x", ["f", "g"]),
        ("abstract class A { abstract m(): void; static { init(); } #p = 1; ['q'] = 2; @dec() n?: string }", ["A", "p", "n"]),
        ("declare module 'x' { export function inner(a: string): void }\nnamespace N { const deep = 1 }", ["deep"]),
        ("let x: { a: (b: number) => void } | null = null, y = x!", ["x", "y"]),
    ],
)
def test_odd_syntax(source, names):
    assert [s["name"] for s in tsjs.extract(source, ".ts")["symbols"]] == names


def test_empty_and_deep():
    assert tsjs.extract("", ".ts")["symbols"] == []
    assert len(tsjs.extract("const x = 1;\n" * 3000, ".js")["symbols"]) == 3000


def test_css():
    f = css.extract(FILES["src/style.module.css"], "src/style.module.css")
    assert [(v["name"], v["value"], v["scope"], v["line_number"]) for v in f["css_variables"]] == [("--main", "rgb(51, 102, 204)", ":root", 3), ("--gap", "1rem", ":root", 4)]
    assert [(c["name"], c["is_module"], c["line_number"]) for c in f["css_classes"]] == [("card", 1, 6), ("wide", 1, 6)]
    assert f["css_keyframes"] == [{"name": "fade", "line_number": 7}] and f["sources"] == ["./base.css"]
    assert [c["name"] for c in css.extract(FILES["src/base.css"], "b.css")["css_classes"]] == ["base"]


def test_markers_cross_lines_and_keep_numbers():
    found = [(m["line_number"], m["kind"], m["content"]) for m in find_markers(FILES["docs/notes.md"])]
    assert found == [(2, "FIXME", "later"), (4, "HACK", "now"), (5, "TODO", "next line"), (7, "NOTE", "this")]
    assert find_markers("") == [] and find_markers("TODOS: none") == []


def test_suppressions():
    assert find_suppressions(FILES["src/side.ts"]) == [{"line_number": 3, "recipe_id": "untested-and-dead"}]
    assert find_suppressions("x // loomgraph-disable-file a") == []


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("src/*", ["src/a/b.ts"], ["lib/a"]), ("*.t?", ["a/b.ts"], ["a.tsx"]), ("a[^b]c", ["axc"], ["abc"]), ("a[b-d].x", ["ac.x"], ["aaxx"]), ("a[", [], ["a["]), ("[]]x", ["]x"], ["ax"])],
)
def test_globs(glob, yes, no):
    import re

    assert all(re.search(glob_to_regex(glob), s) for s in yes) and not any(re.search(glob_to_regex(glob), s) for s in no)


def test_owner_globs():
    import re

    hits = lambda g, p: bool(re.search(owner_glob_to_regex(g), p))
    assert hits("/src/", "src/a/b") and not hits("/src/", "lib/src/a") and hits("*.md", "docs/x.md") and hits("docs/**", "a/docs/x/y") and not hits("/a*b", "a/b")
    assert [(r.pattern, r.owners) for r in parse_owners(FILES["CODEOWNERS"])] == [("*.md", ("@docs",)), ("/src/", ("@core", "@second")), ("/src/ui/", ("@design",))]


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("fixme", "fixm"), ("todo", "todo"), ("happy", "happi"), ("adjustment", "adjust"), ("controlling", "control"), ("rate", "rate")])
def test_stems(word, want):
    assert stem(word) == want


def test_tokens():
    assert tokens("Café-Bar_2, x!") == ["cafe", "bar", "2", "x"]


def test_candidates():
    assert candidates("./a.js", "src/x.ts", [])[:3] == ["src/a.js", "src/a.ts", "src/a.tsx"]
    assert "src/ui/index.ts" in candidates("~/ui", "z.ts", [("~/*", ["src/*"])])
    assert candidates("react", "z.ts", []) == []
