"""Operators on rows that name a file: the changed-file filter and grouping into buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.globs import OwnerRule

#: In order of preference.
PATH_COLUMNS = tuple("path file_path from_path to_path resolved_path".split())
UNKNOWN, NO_OWNER, ROOT = "<unknown>", "<no-owner>", "<root>"


def path_columns(df: DataFrame) -> list[str]:
    """The columns of df that may name a file."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return [c for c in PATH_COLUMNS if c in strings]


def changed_filter(df: DataFrame, changed: Iterable[str] | DataFrame) -> DataFrame:
    """Rows of which some path has changed, and rows that name no file.

    changed: the paths, few enough to come from the driver, or a DataFrame of one column of any size.
    """
    own = path_columns(df)
    if not own:
        return df
    nothing = F.coalesce(*[F.col(c) for c in own]).isNull()
    if not isinstance(changed, DataFrame):
        paths = sorted(set(changed))
        hit = F.lit(False)
        for c in own:
            hit = hit | F.coalesce(F.col(c).isin(paths), F.lit(False))
        return df.where(hit | nothing)
    name = changed.columns[0]
    wide = df
    for c in own:
        wide = wide.join(changed.select(F.col(name).alias(f"__{c}")).distinct(), F.col(c) == F.col(f"__{c}"), "left")
    return wide.where(F.coalesce(*[F.col(f"__{c}") for c in own]).isNotNull() | nothing).select(*df.columns)


def chosen_path(df: DataFrame) -> Column:
    """The first path of a row that isn't empty; null if it has none."""
    own = [F.when(F.length(c) > 0, F.col(c)) for c in path_columns(df)]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def by_directory(path: Column) -> Column:
    """The first segment."""
    return F.substring_index(path, "/", 1)


def by_owner(rules: list[OwnerRule]) -> Callable[[Column], Column]:
    """The first owner of the last rule that matches; null if none does."""

    def key(path: Column) -> Column:
        owner = F.lit(None).cast("string")
        for rule in rules:
            owner = F.when(path.rlike(rule.regex), F.lit(rule.owners[0])).otherwise(owner)
        return owner

    return key


def by_package(roots: Iterable[str]) -> Callable[[Column], Column]:
    """The longest workspace folder that holds the path, else ROOT."""
    ordered = sorted(set(roots), key=lambda r: (-len(r), r))

    def key(path: Column) -> Column:
        found = [F.when((path == r) | path.startswith(r.rstrip("/") + "/"), F.lit(r)) for r in ordered]
        return F.coalesce(*found, F.lit(ROOT))

    return key


def with_bucket(df: DataFrame, bucket: Callable[[Column], Column], missing: str = UNKNOWN) -> DataFrame:
    """df with the column key; missing is the key of a path without a bucket."""
    path = chosen_path(df)
    return df.withColumn("key", F.when(path.isNull(), UNKNOWN).otherwise(F.coalesce(bucket(path), F.lit(missing))))


def group_rows(df: DataFrame, bucket: Callable[[Column], Column], missing: str = UNKNOWN, summary: bool = False) -> DataFrame:
    """(key, count), largest first; without summary a line for each row, (key, count, row), the rows of a key together.

    A key may have any share of the rows: counts combine before the shuffle, and rows are sorted by
    their path within a key, so no key is gathered in one place.
    """
    keyed = with_bucket(df, bucket, missing)
    counts = keyed.groupBy("key").agg(F.count("*").alias("count"))
    if summary:
        return counts.orderBy(F.desc("count"), "key")
    rows = keyed.select("key", F.struct(*[F.col(c) for c in df.columns]).alias("row"), chosen_path(df).alias("__path"))
    return rows.join(counts, "key").orderBy(F.desc("count"), "key", "__path").select("key", "count", "row")


def gathered(lines: Iterable) -> list[dict]:
    """[{key, count, rows}] of the lines of group_rows, as they come."""
    out: list[dict] = []
    for line in lines:
        if not out or out[-1]["key"] != line["key"]:
            out.append({"key": line["key"], "count": line["count"], "rows": []})
        out[-1]["rows"].append(line["row"])
    return out
