"""Multiset differences of row sets, and the audit made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MissingColumns(ValueError):
    """A baseline lacks columns that a comparison needs."""


#: Surplus copies of a row that are made at a time.
_BLOCK = 10_000


def surplus(base: DataFrame, current: DataFrame) -> DataFrame:
    """Each different row once, with __n: how often more it occurs now (below 0: less); rows in balance go.

    Both sides are scanned and shuffled once, combined before that, and serve both answers.
    """
    sides = [side.select(*[F.col(c) for c in current.columns], F.lit(n).alias("__n")) for side, n in ((base, -1), (current, 1))]
    return sides[0].unionAll(sides[1]).groupBy(*current.columns).agg(F.sum("__n").alias("__n")).where("__n != 0")


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as __n says, without it; in blocks, so that no array grows with the count."""
    n = F.abs("__n")
    blocks = rows.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), ((n - 1) / _BLOCK).cast("bigint"))))
    within = F.least(n - F.col("__k") * _BLOCK, F.lit(_BLOCK).cast("bigint"))
    return blocks.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), within))).drop("__n", "__k", "__i")


def diff_rows(base: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed), each row as often as it is in surplus. Rows of other columns are other rows."""
    if set(base.columns) != set(current.columns):
        return current, base
    n = surplus(base, current)
    return _repeated(n.where("__n > 0")), _repeated(n.where("__n < 0"))


@dataclass(frozen=True)
class Delta:
    """What an audit compares under a name: a table, which of its rows, and the columns that count."""

    key: str
    table: str
    columns: tuple[str, ...]
    where: str = "true"

    def rows(self, tables) -> DataFrame:
        return tables[self.table].where(self.where).select(*self.columns)


DELTAS = (
    Delta("files", "files", ("path",)),
    Delta("dependencies", "dependencies", ("from_path", "to_path")),
    Delta("deprecated", "symbols", ("name", "kind", "file_path"), "contains(doc_comment, '@deprecated')"),
)


def _sides(base: DataFrame, current: DataFrame, delta: Delta) -> tuple[DataFrame, DataFrame]:
    """Both sides on the columns of the delta. An empty base without columns is allowed."""
    lacking = [c for c in delta.columns if c not in base.columns]
    if lacking:
        if base.columns and not base.isEmpty():
            raise MissingColumns(f"the baseline for {delta.key} lacks {', '.join(lacking)}; it has {', '.join(base.columns)}")
        base = current.limit(0)
    return base.select(*delta.columns), current.select(*delta.columns)


def compute_delta(base: DataFrame, current: DataFrame, delta: Delta) -> tuple[DataFrame, DataFrame]:
    """(added, removed) on the columns of the delta."""
    return diff_rows(*_sides(base, current, delta))


def audit_rows(base, current, deltas: tuple[Delta, ...] = DELTAS) -> DataFrame:
    """(delta, change, row) of all deltas between two sets of tables; row is JSON."""
    parts = None
    for d in deltas:
        n = surplus(*_sides(d.rows(base), d.rows(current), d))
        change = F.when(F.col("__n") > 0, "added").otherwise("removed")
        part = _repeated(n.select(F.lit(d.key).alias("delta"), change.alias("change"), F.to_json(F.struct(*d.columns)).alias("row"), "__n"))
        parts = part if parts is None else parts.unionByName(part)
    return parts
