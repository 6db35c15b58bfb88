"""Recipes by name: those of the package, and those that a project adds as .sql and .md files."""

from __future__ import annotations

import re
from pathlib import Path

import yaml

from loomgraph.plans.recipes import ALIASES, RECIPES, Param, Recipe

_WRITES = {"insert", "update", "delete", "drop", "create", "alter", "truncate", "merge", "replace", "set", "cache", "add", "load", "attach", "pragma", "vacuum", "use"}


class RecipeError(ValueError):
    pass


def split_front(text: str) -> tuple[dict, str]:
    """The front matter of a Markdown text, and the text after it."""
    m = re.match(r"^---\r?\n(.*?)\r?\n---\r?\n?(.*)$", text, re.S)
    if not m:
        return {}, text
    try:
        found = yaml.safe_load(m[1])
    except yaml.YAMLError as e:
        raise RecipeError(f"front matter: {e}") from e
    return found if isinstance(found, dict) else {}, m[2]


def first_word(sql: str) -> str:
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip()
    m = re.match(r"[A-Za-z]+", plain)
    return m[0].lower() if m else ""


def load_project(folder: str) -> dict[str, Recipe]:
    """Recipes of a folder. A .md beside the .sql describes it, its parameters and its actions."""
    out = {}
    for path in sorted(Path(folder).glob("*.sql")):
        sql = path.read_text().strip().rstrip(";")
        word = first_word(sql)
        if not word:
            raise RecipeError(f"{path.name} is empty")
        if word in _WRITES:
            raise RecipeError(f"{path.name} begins with {word.upper()}; a recipe only reads")
        note = path.with_suffix(".md")
        front, body = split_front(note.read_text()) if note.exists() else ({}, "")
        params = []
        for p in front.get("params") or ():
            if p.get("type", "string") not in ("string", "number", "boolean"):
                raise RecipeError(f"{path.name}: parameter {p.get('name')} has type {p.get('type')!r}")
            params.append(Param(p["name"], p.get("type", "string"), bool(p.get("required", True)), p.get("default")))
        actions = tuple({"type": a["type"], "auto_fixable": bool(a.get("auto_fixable", False)), "description": a.get("description")} for a in front.get("actions") or ())
        lines = [x.strip("# ").strip() for x in body.split("\n") if x.strip()]
        out[path.stem] = Recipe(path.stem, front.get("description") or (lines[0] if lines else path.stem), None, tuple(params), actions, sql)
    return out


class Registry:
    def __init__(self, folder: str | None = None):
        self.project = load_project(folder) if folder and Path(folder).is_dir() else {}

    def get(self, name: str) -> Recipe:
        """A recipe by id or alias; a project's shadows one of the package."""
        for key in (name, ALIASES.get(name, "")):
            if key in self.project:
                return self.project[key]
            if key in RECIPES:
                return RECIPES[key]
        raise KeyError(name)

    def ids(self) -> list[str]:
        return sorted(set(RECIPES) | set(self.project))

    def catalogue(self, recency: dict[str, dict] | None = None) -> list[dict]:
        out = []
        for i in self.ids():
            r = self.get(i)
            seen = (recency or {}).get(i, {})
            out.append({
                "id": i, "description": r.description, "source": "project" if i in self.project else "bundled", "shadows": i in self.project and i in RECIPES,
                "params": [{"name": p.name, "type": p.kind, "required": p.required, "default": p.default} for p in r.params], "actions": list(r.actions), "sql": r.sql or r.shown,
                "last_run_at": seen.get("last_run_at"), "run_count": seen.get("run_count", 0),
            })
        return out


def parse_params(text: str | list[str]) -> dict[str, str]:
    """`a=1,b=2`, or a list of such; the first = splits."""
    out = {}
    for part in [text] if isinstance(text, str) else text:
        for pair in part.split(","):
            key, sign, value = pair.partition("=")
            if not sign or not key.strip():
                raise RecipeError(f"{pair!r} isn't name=value")
            out[key.strip()] = value
    return out


def bind(recipe: Recipe, given: dict | None) -> dict[str, object]:
    """Checked and converted values in the order of declaration."""
    given = dict(given or {})
    if unknown := sorted(set(given) - {p.name for p in recipe.params}):
        raise RecipeError(f"{recipe.id} has no parameter {', '.join(unknown)}")
    out: dict[str, object] = {}
    for p in recipe.params:
        value = given.get(p.name, p.default)
        if value is None:
            if p.required:
                raise RecipeError(f"{recipe.id} needs {p.name}")
            out[p.name] = None
        elif p.kind == "number":
            try:
                number = float(value) if not isinstance(value, bool) else None
            except (TypeError, ValueError):
                number = None
            if number is None or number != number or number in (float("inf"), float("-inf")):
                raise RecipeError(f"{p.name}: {value!r} is no number")
            out[p.name] = int(number) if number == int(number) else number
        elif p.kind == "boolean":
            known = {"true": True, "1": True, "false": False, "0": False}
            text = str(value).lower()
            if text not in known:
                raise RecipeError(f"{p.name}: {value!r} is neither true nor false")
            out[p.name] = known[text]
        else:
            out[p.name] = str(value)
    return out
