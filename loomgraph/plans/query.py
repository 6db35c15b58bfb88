"""The query engine: SQL or a recipe, then the steps that follow it, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import paths
from loomgraph.plans import guard
from loomgraph.plans.registry import Recipe, bind
from loomgraph.schema import Tables


@dataclass(frozen=True)
class Grouping:
    name: str
    bucket: Callable[[Column], Column]
    missing: str = paths.UNKNOWN


def plan_sql(tables: Tables, sql: str, args: dict | list | None = None) -> DataFrame:
    """A DataFrame for read-only SQL over the tables; their names are views of this session."""
    guard.check(tables.spark, sql, set(tables))
    tables.register()
    return tables.spark.sql(sql, args=args) if args else tables.spark.sql(sql)


def plan_recipe(tables: Tables, recipe: Recipe, params: dict | None = None) -> DataFrame:
    values = bind(recipe, params)
    if recipe.sql is not None:
        return plan_sql(tables, recipe.sql, list(values.values()) or None)
    return recipe.build(tables, **{k: v for k, v in values.items() if v is not None})


def with_actions(df: DataFrame, actions: Iterable[dict]) -> DataFrame:
    """df with the recipe's actions on each row, unless rows have their own."""
    actions = list(actions)
    if not actions or "actions" in df.columns:
        return df
    each = [F.struct(F.lit(a["type"]).alias("type"), F.lit(a.get("auto_fixable")).alias("auto_fixable"), F.lit(a.get("description")).alias("description")) for a in actions]
    return df.withColumn("actions", F.array(*each))


def follow(df: DataFrame, changed: Iterable[str] | DataFrame | None = None, group: Grouping | None = None, summary: bool = False, actions: Iterable[dict] = ()) -> DataFrame:
    """The steps after a query: the changed filter (past any limit of the query), then groups, a count, or actions."""
    if changed is not None:
        df = paths.changed_filter(df, changed)
    if group is not None:
        return paths.group_rows(df if summary else with_actions(df, actions), group.bucket, group.missing, summary)
    if summary:
        return df.agg(F.count("*").alias("count"))
    return with_actions(df, actions)


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def execute(tables: Tables, sql: str | None = None, recipe: Recipe | None = None, params: dict | None = None, changed=None, group: Grouping | None = None, summary: bool = False) -> object:
    """The envelope: rows, {count}, {group_by, groups} or {error}."""
    try:
        df = plan_recipe(tables, recipe, params) if recipe else plan_sql(tables, sql or "")
        rows = rows_of(follow(df, changed, group, summary, recipe.actions if recipe else ()))
    except Exception as e:
        return {"error": str(e).split("\n\nJVM")[0]}
    if group is not None:
        return {"group_by": group.name, "groups": rows if summary else paths.gathered(rows)}
    return {"count": rows[0]["count"]} if summary else rows


def execute_batch(tables: Tables, statements: Iterable[str | dict], defaults: dict | None = None) -> list:
    """One envelope for each statement; an error in one leaves the others alone."""
    out = []
    for s in statements:
        own = {"sql": s} if isinstance(s, str) else dict(s)
        out.append(execute(tables, **(defaults or {}) | own))
    return out
