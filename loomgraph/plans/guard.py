"""What ad hoc SQL may do: read the tables it is given, by a plan of known harmless parts."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "LateralJoin", "Union", "Intersect", "Except", "Distinct", "SubqueryAlias", "UnresolvedWith", "WithCTE", "CTERelationDef", "UnresolvedRelation",
    "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "LocalRelation", "UnresolvedInlineTable", "Generate", "Window", "WithWindowDefinition", "UnresolvedTableValuedFunction", "Pivot", "UnresolvedPivot", "Unpivot", "Sample", "Tail",
    "UnionLoop", "UnionLoopRef", "Range", "Values", "AliasedExpression", "UnresolvedTVFAliases", "ResolvedInlineTable",
}
_FUNCTIONS = re.compile(r"\b(reflect|java_method|try_reflect|input_file_name|input_file_block_start|input_file_block_length|raise_error|version)\s*\(", re.I)


class ReadOnlyError(ValueError):
    """The statement isn't a plain query over the tables."""


def _names(plan) -> list[str]:
    """Class names of all nodes of a plan, those in subqueries and named queries too."""
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        out.append(node.getClass().getSimpleName())
        for part in (node.children(), node.innerChildren(), node.subqueries() if hasattr(node, "subqueries") else None):
            if part is None:
                continue
            items = part.iterator()
            while items.hasNext():
                item = items.next()
                if "plans.logical" in item.getClass().getName() or "analysis.Unresolved" in item.getClass().getName() or "catalyst.analysis" in item.getClass().getName():
                    todo.append(item)
    return out


def check(spark: SparkSession, sql: str, tables: set[str]) -> None:
    """Raise ReadOnlyError unless sql only reads the tables. What isn't known is refused."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        text = str(getattr(e, "java_exception", e)).split("\n")
        raise ReadOnlyError(next((x for x in text if "[" in x), text[0])[:400]) from e
    odd = sorted(set(_names(plan)) - _NODES)
    if odd:
        raise ReadOnlyError(f"only queries are allowed, and this has {', '.join(odd)}")
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/", "''", sql, flags=re.S)
    if m := _FUNCTIONS.search(bare):
        raise ReadOnlyError(f"the function {m[1]} isn't allowed")
    # Relations of the form format.`path` would read any file.
    if re.search(r"\b(?:from|join)\s+\(?\s*(?:[A-Za-z_]\w*\s*\.|`[^`]*`\s*\.)|,\s*[A-Za-z_]\w*\s*\.\s*`[^`]*[/:]", bare, re.I) or re.search(r"`[^`]*[/:][^`]*`", bare):
        raise ReadOnlyError("relations have a plain name: " + ", ".join(sorted(tables)))
