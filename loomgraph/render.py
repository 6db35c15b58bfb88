"""Renderers of small results: SARIF, CI annotations, flowcharts, rename diffs and review comments."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

TOOL, VERSION = "loomgraph", "0.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
PLACES = ("file_path", "path", "to_path", "from_path")
MAX_EDGES, MAX_COMMENT_ROWS = 50, 50
FORMATS = ("annotations", "diff", "diff-json", "json", "mermaid", "sarif", "text")


class FormatError(ValueError):
    """A format that doesn't fit the rows or the other options."""


def check_format(fmt: str, summary: bool = False, grouped: bool = False, baseline: bool = False) -> None:
    if fmt not in FORMATS:
        raise FormatError(f"{fmt!r} is none of {', '.join(FORMATS)}")
    if fmt in ("json", "text"):
        return
    for used, what in ((summary, "a summary"), (grouped, "groups"), (baseline, "a baseline diff")):
        if used:
            raise FormatError(f"{fmt} shows rows and can't show {what}")


def place_of(row: dict) -> str | None:
    """The column that says where a row belongs."""
    return next((c for c in PLACES if isinstance(row.get(c), str) and row[c]), None)


def message(row: dict) -> str:
    """What a row says: its name with kind and signature, else its other columns."""
    if isinstance(row.get("name"), str) and row["name"]:
        extra = row.get("signature") or row.get("kind")
        return f"{row['name']}: {extra}" if extra else row["name"]
    skip = {*PLACES, "line_start", "line_end", "actions"}
    rest = [f"{k}={v}" for k, v in row.items() if k not in skip and v is not None]
    return ", ".join(rest) or "(no message)"


def _location(row: dict) -> list[dict]:
    at = place_of(row)
    if at is None:
        return []
    region = {k: row[c] for k, c in (("startLine", "line_start"), ("endLine", "line_end")) if isinstance(row.get(c), int) and row[c] > 0}
    return [{"physicalLocation": {"artifactLocation": {"uri": row[at]}} | ({"region": region} if region else {})}]


def _sarif(rules: list[dict], results: list[dict]) -> str:
    driver = {"name": TOOL, "version": VERSION, "rules": rules}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2, default=str)


def sarif(rows: Iterable[dict], recipe_id: str | None = None, description: str | None = None, body: str | None = None) -> str:
    """Rows that name a file as notes; others are left out."""
    rule_id = f"{TOOL}.{recipe_id or 'adhoc'}"
    rule = {"id": rule_id, "name": recipe_id or "adhoc", "shortDescription": {"text": description or recipe_id or "Ad hoc query"}, "defaultConfiguration": {"level": "note"}}
    if body:
        rule["fullDescription"] = {"text": body}
    return _sarif([rule], [{"ruleId": rule_id, "level": "note", "message": {"text": message(r)}, "locations": where} for r in rows if (where := _location(r))])


def audit_sarif(deltas: dict[str, list[dict]]) -> str:
    """Added rows of each delta as warnings; what was removed isn't a finding."""
    rules, results = [], []
    for key, added in deltas.items():
        rule_id = f"{TOOL}.audit.{key}-added"
        rules.append({"id": rule_id, "name": f"audit-{key}-added", "shortDescription": {"text": f"New {key} since the baseline"}, "defaultConfiguration": {"level": "warning"}})
        for r in added:
            where, text = _location(r), message(r)
            if text == "(no message)" and where:
                text = f"new {key}: {r[place_of(r)]}"
            results.append({"ruleId": rule_id, "level": "warning", "message": {"text": text}} | ({"locations": where} if where else {}))
    return _sarif(rules, results)


def _data(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _property(text: str) -> str:
    return _data(text).replace(":", "%3A").replace(",", "%2C")


def annotations(rows: Iterable[dict], level: str = "notice") -> str:
    """One workflow command for each row that names a file."""
    out = []
    for r in rows:
        if (at := place_of(r)) is None:
            continue
        where = [f"file={_property(r[at])}"]
        where += [f"{k}={r[c]}" for k, c in (("line", "line_start"), ("endLine", "line_end")) if isinstance(r.get(c), int) and r[c] > 0]
        out.append(f"::{level} {','.join(where)}::{_data(message(r))}")
    return "\n".join(out)


def _label(text: str) -> str:
    return '"' + text.replace('"', "#quot;").replace("\n", " ") + '"'


def mermaid(rows: Iterable[dict], recipe_id: str | None = None) -> str:
    """A flowchart of rows with from and to, label if there is one. More than MAX_EDGES are an error, never cut."""
    rows = list(rows)
    if len(rows) > MAX_EDGES:
        raise FormatError(f"{recipe_id or 'the query'} has {len(rows)} edges, a flowchart at most {MAX_EDGES}; narrow it with LIMIT or WHERE")
    ids: dict[str, str] = {}
    lines = ["flowchart LR"]

    def node(name: str) -> str:
        if name not in ids:
            ids[name] = f"n{len(ids)}"
            fresh.append(name)
        return ids[name]

    for r in rows:
        ends = [r.get(k) if isinstance(r.get(k), str) and r.get(k) else r.get(k2) for k, k2 in (("from", "from_path"), ("to", "to_path"))]
        if not all(isinstance(e, str) and e for e in ends):
            continue
        fresh: list[str] = []
        a, b = node(ends[0]), node(ends[1])
        lines += [f"  {ids[n]}[{_label(n)}]" for n in fresh]
        label = r.get("label")
        lines.append(f"  {a} -->{'|' + _label(label) + '|' if isinstance(label, str) and label else ''} {b}")
    return "\n".join(lines)


def edits(rows: Iterable[dict], read: Callable[[str], str | None]) -> dict:
    """What rows with before_pattern and after_pattern would change: {files: [...], summary}.

    The first occurrence in the row's line is replaced, as plain text. A file that can't be read is
    missing; a line without the pattern makes its file stale.
    """
    by_file: dict[str, list[dict]] = {}
    for r in rows:
        if all(isinstance(r.get(k), str) for k in ("file_path", "before_pattern", "after_pattern")) and isinstance(r.get("line_start"), int):
            by_file.setdefault(r["file_path"], []).append(r)
    files, hunks = [], 0
    for path in sorted(by_file):
        text = read(path)
        entry: dict = {"file_path": path, "missing": text is None, "stale": False, "hunks": []}
        if text is not None:
            lines = text.split("\n")
            changed: dict[int, str] = {}
            for r in by_file[path]:
                n = r["line_start"]
                old = changed.get(n, lines[n - 1]) if 0 < n <= len(lines) else None
                if old is None or r["before_pattern"] not in old:
                    entry["stale"] = True
                else:
                    changed[n] = old.replace(r["before_pattern"], r["after_pattern"], 1)
            for n, new in sorted(changed.items()):
                entry["hunks"].append({"old_start": n, "old_count": 1, "new_start": n, "new_count": 1, "lines": [{"type": "remove", "text": lines[n - 1]}, {"type": "add", "text": new}]})
        hunks += len(entry["hunks"])
        files.append(entry)
    return {"files": files, "summary": {"files": len(files), "hunks": hunks, "missing": sum(f["missing"] for f in files), "stale": sum(f["stale"] for f in files)}}


def unified(rows: Iterable[dict], read: Callable[[str], str | None]) -> str:
    """The same as a unified diff, with notes on files that are missing or stale."""
    out = []
    for f in edits(rows, read)["files"]:
        if f["missing"] or f["stale"]:
            out.append(f"# {'missing' if f['missing'] else 'stale'}: {f['file_path']}")
        if f["hunks"]:
            out += [f"--- a/{f['file_path']}", f"+++ b/{f['file_path']}"]
        for h in f["hunks"]:
            out.append(f"@@ -{h['old_start']},{h['old_count']} +{h['new_start']},{h['new_count']} @@")
            out += [("-" if x["type"] == "remove" else "+") + x["text"] for x in h["lines"]]
    return "\n".join(out)


def text_table(rows: list[dict]) -> str:
    if not rows:
        return "(no rows)"
    names = list(rows[0])
    cells = [["" if r.get(c) is None else str(r[c]) for c in names] for r in rows]
    width = [max(len(n), *(len(row[i]) for row in cells)) for i, n in enumerate(names)]
    line = lambda row: "  ".join(x.ljust(w) for x, w in zip(row, width)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in width]), *map(line, cells)])


def _cell(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", "" if value is None else str(value)).replace("|", "\\|")


def _section(title: str, rows: list[dict]) -> list[str]:
    if not rows:
        return []
    names = list(rows[0])
    out = [f"<details><summary>{title} ({len(rows)})</summary>", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    out += ["| " + " | ".join(_cell(r.get(c)) for c in names) + " |" for r in rows[:MAX_COMMENT_ROWS]]
    if len(rows) > MAX_COMMENT_ROWS:
        out.append(f"\n… and {len(rows) - MAX_COMMENT_ROWS} more")
    return [*out, "", "</details>", ""]


def comment(found: dict) -> str:
    """A review comment in Markdown from an audit or a SARIF document, which is told by its keys."""
    out = ["## Structural review", ""]
    if "deltas" in found:
        total = 0
        for key, d in found["deltas"].items():
            for change in ("added", "removed"):
                rows = d.get(change) or []
                total += len(rows)
                out += _section(f"{key}: {change}", rows)
        if not total:
            out.append("No structural changes.")
    elif "runs" in found:
        rows: dict[str, list[dict]] = {}
        for run in found["runs"]:
            for r in run.get("results", ()):
                where = (r.get("locations") or [{}])[0].get("physicalLocation", {})
                rows.setdefault(r.get("ruleId", "?"), []).append({"file": where.get("artifactLocation", {}).get("uri"), "line": where.get("region", {}).get("startLine"), "message": r.get("message", {}).get("text")})
        for rule, some in rows.items():
            out += _section(rule, some)
        if not rows:
            out.append("No findings.")
    else:
        raise FormatError("neither an audit nor a SARIF document")
    return "\n".join(out).rstrip() + "\n"


def exit_code(fmt: str, rows: list[dict] | None = None, audit: dict | None = None) -> int:
    """For CI: 1 if a SARIF run has rows, or an audit additions. Annotations only inform."""
    if audit is not None:
        return int(any(d.get("added") for d in audit.get("deltas", {}).values()))
    return int(fmt == "sarif" and bool(rows))
