"""Imports to files: candidates in order of preference, joined with the files that there are."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENSIONS = tuple(".ts .tsx .d.ts .js .jsx .mts .mjs .cts .cjs .json .css".split())
#: A source that names a compiled file may stand for what it is compiled from.
_COMPILED = {".js": (".ts", ".tsx", ".js", ".jsx"), ".jsx": (".tsx", ".jsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs")}


def first_existing(df: DataFrame, files: DataFrame, key: str, candidates: str = "candidates") -> DataFrame:
    """(key, resolved_path): for each row the first of its candidates among files.path; null if none is."""
    tried = df.select(key, F.posexplode(candidates).alias("rank", "path")).join(files.select("path").distinct(), "path")
    best = tried.groupBy(key).agg(F.min_by("path", "rank").alias("resolved_path"))
    return df.select(key).join(best, key, "left")


def aliases(root: str, tsconfig: str | None = None) -> list[tuple[str, list[str]]]:
    """(pattern, targets relative to the root) of the compiler's path mapping, the longest prefix first."""
    path = Path(tsconfig) if tsconfig else Path(root) / "tsconfig.json"
    if not path.is_absolute():
        path = Path(root) / path
    try:
        text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", path.read_text(), flags=re.S)
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", text)).get("compilerOptions", {})
    except (OSError, ValueError):
        return []
    base = os.path.normpath(path.parent / options.get("baseUrl", "."))
    at = os.path.relpath(base, root)
    found = [(k, [os.path.normpath(os.path.join(at, t)) for t in v]) for k, v in options.get("paths", {}).items()]
    if "baseUrl" in options:
        found.append(("*", [os.path.normpath(os.path.join(at, "*"))]))
    return sorted(found, key=lambda x: (-len(x[0].split("*")[0]), x[0] == "*"))


def candidates(source: str, importer: str, mapping: list[tuple[str, list[str]]]) -> list[str]:
    """Paths that an import may mean, the likeliest first."""
    bases: list[str] = []
    if source.startswith("."):
        bases.append(os.path.normpath(os.path.join(os.path.dirname(importer), source)))
    else:
        for pattern, targets in mapping:
            before, star, after = pattern.partition("*")
            if star and source.startswith(before) and source.endswith(after) and len(source) >= len(before) + len(after):
                bases += [t.replace("*", source[len(before) : len(source) - len(after) or None], 1) for t in targets]
            elif source == pattern:
                bases += targets
    out: list[str] = []
    for b in bases:
        b = b.replace(os.sep, "/")
        stem, ext = os.path.splitext(b)
        out.append(b)
        out += [stem + e for e in _COMPILED.get(ext, ())]
        out += [b + e for e in EXTENSIONS]
        out += [f"{b}/index{e}" for e in EXTENSIONS]
    return list(dict.fromkeys(out))


def resolve(imports: DataFrame, files: DataFrame, mapping: list[tuple[str, list[str]]]) -> DataFrame:
    """imports with resolved_path, by a join with the files; style imports stay unresolved."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "candidates": [candidates(s, f, mapping) for s, f in zip(p["source"], p["file_path"])]})

    named = imports.where(~F.col("file_path").endswith(".css"))
    found = first_existing(named.select("id", "source", "file_path").mapInPandas(run, "id bigint, candidates array<string>"), files, "id")
    return imports.drop("resolved_path").join(found, "id", "left").select(*imports.columns)


def dependencies(imports: DataFrame) -> DataFrame:
    """(from_path, to_path), once each."""
    return imports.where("resolved_path IS NOT NULL").select(F.col("file_path").alias("from_path"), F.col("resolved_path").alias("to_path")).distinct()
