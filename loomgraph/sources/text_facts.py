"""Facts that any text may hold: markers such as TODO, and directives that suppress a recipe."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKERS = ("TODO", "FIXME", "HACK", "NOTE")
_LEADER = r"(?://|#|--|<!--|/\*)"


def find_markers(text: str, keywords: tuple[str, ...] = MARKERS) -> list[dict]:
    """Each keyword with what follows it on its line, or on the next if it ends its own."""
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    pattern = re.compile(rf"\b({'|'.join(map(re.escape, keywords))})[\s:]+(.+)")
    return [{"line_number": bisect_right(starts, m.start()), "kind": m[1], "content": m[2].strip()} for m in pattern.finditer(text)]


def find_suppressions(text: str, tool: str = "loomgraph") -> list[dict]:
    """`<leader> loomgraph-disable-next-line <recipe>` holds for the line after it; `-disable-file` for the file, as line 0."""
    pattern = re.compile(rf"^\s*{_LEADER}\s*{re.escape(tool)}-disable-(next-line|file)\s+([\w-]+)")
    found = ((i, pattern.match(line)) for i, line in enumerate(text.split("\n"), 1))
    return [{"line_number": 0 if m[1] == "file" else i + 1, "recipe_id": m[2]} for i, m in found if m]


def markers(df: DataFrame, id_col: str, text_col: str, keywords: tuple[str, ...] = MARKERS) -> DataFrame:
    """(id_col, line_number, kind, content). Only texts that hold a keyword reach Python, in Arrow batches."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(i, m["line_number"], m["kind"], m["content"]) for i, text in zip(p[id_col], p[text_col]) for m in find_markers(text, keywords)]
            yield pd.DataFrame(rows, columns=[id_col, "line_number", "kind", "content"])

    some = df.select(id_col, text_col).where(F.col(text_col).rlike(rf"\b({'|'.join(map(re.escape, keywords))})[\s:]"))
    return some.mapInPandas(run, f"{id_col} {kind}, line_number int, kind string, content string")
