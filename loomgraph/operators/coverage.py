"""Coverage: statements attributed to the innermost symbol whose lines hold them."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Lines of a cell, as a power of two; an interval is sent to each cell that it reaches into.
CELL = 8


def innermost(points: DataFrame, intervals: DataFrame, key: str, at: str, begin: str = "line_start", end: str = "line_end", tie: str = "id", ids: tuple[str, ...] = ("point_id",), how: str = "left") -> DataFrame:
    """Each point of points with the smallest interval of its key that holds it; nulls where none does (how inner: no row).

    ids are columns that tell the points of a key apart. Of equal spans the interval that begins first
    wins, then the least tie. Points and intervals meet by key and cell of lines, so a key with very
    many of both is spread over its cells, and points are shuffled once: the choice among a point's
    intervals is made where they meet.
    """
    order = F.struct((F.col(end) - F.col(begin)).alias("span"), F.col(begin).alias("b"), F.col(tie).alias("t"))
    cells = F.sequence(F.shiftright(begin, CELL), F.shiftright(end, CELL))
    others = [c for c in intervals.columns if c not in points.columns]
    held = intervals.where(F.col(begin) <= F.col(end)).select(
        F.col(key).alias("__key"), F.explode(cells).alias("__of"), order.alias("__order"), F.struct(*others).alias("__interval"), F.col(begin).alias("__from"), F.col(end).alias("__to")
    )
    inside = (F.col(key) == F.col("__key")) & (F.col("__cell") == F.col("__of")) & F.col(at).between(F.col("__from"), F.col("__to"))
    met = points.withColumn("__cell", F.shiftright(at, CELL)).join(held, inside, how)
    same = [key, "__cell", *[c for c in ids if c != key]]
    rest = [c for c in points.columns if c not in same]
    best = met.groupBy(*same).agg(F.min_by("__interval", "__order").alias("__interval"), *[F.any_value(c).alias(c) for c in rest])
    return best.select(*points.columns, F.col("__interval").isNotNull().alias("matched"), *[F.col(f"__interval.{c}").alias(c) for c in others])


class Ingest:
    """The coverage table after an ingest, which is lazy, and the counts of the ingest, made by one job when first asked for."""

    def __init__(self, coverage: DataFrame, counts: DataFrame, kind: str):
        self.coverage, self.format, self._one = coverage, kind, counts

    @cached_property
    def _counts(self) -> dict:
        return {k: v or 0 for k, v in self._one.first().asDict().items()}

    def __getattr__(self, name: str) -> int:
        if name not in ("symbols", "files", "unmatched_files", "statements_no_symbol", "pruned_orphans"):
            raise AttributeError(name)
        return self._counts[name]


def normalise(rows: DataFrame, root: str) -> DataFrame:
    """(file_path, line, hit_count) with paths relative to the root; those outside of it go."""
    base = re.escape(root.rstrip("/") + "/")  # one expression each for path and filter: they are copied wherever they are used
    inside = F.regexp_replace(F.translate("file_path", "\\", "/"), rf"^(?:\./)*(?:{base})?", "")
    return rows.withColumn("file_path", inside).where(~F.col("file_path").rlike(r"^(?:/|\.\./|\z)"))


def attribute(statements: DataFrame, symbols: DataFrame) -> DataFrame:
    """Coverage rows of the symbols that own statements: each statement counts, repeated lines too.

    Statements of one line have one owner, so they are counted by line first.
    """
    lines = statements.groupBy("file_path", "line").agg(F.sum(F.when(F.col("hit_count") > 0, 1).otherwise(0)).alias("hit"), F.count("*").alias("all"))
    owned = innermost(lines, symbols.select("file_path", "name", "line_start", "line_end", F.struct("id", "name").alias("own")), "file_path", "line", tie="own", ids=("line",), how="inner")
    hits = owned.groupBy("file_path", "name", "line_start").agg(F.sum("hit").alias("hit_statements"), F.sum("all").alias("total_statements"))
    share = F.col("hit_statements") * F.lit(100.0) / F.col("total_statements")
    return hits.select("file_path", "name", "line_start", share.alias("coverage_pct"), "hit_statements", "total_statements")


def upsert(tables, rows: DataFrame, root: str, kind: str) -> Ingest:
    """The coverage table after an ingest: files seen in the artifact are replaced, files that left the index go.

    Files are held against the index once, when old rows and new ones are together.
    """
    statements = normalise(rows, root)
    indexed = tables.files.select(F.col("path").alias("file_path"))
    seen = statements.select("file_path").distinct()
    fresh = attribute(statements, tables.symbols)
    kept = tables.coverage.join(seen, "file_path", "left_anti")
    after = kept.unionByName(fresh).join(indexed, "file_path", "left_semi")
    there = indexed.distinct().withColumn("there", F.lit(1))
    files = statements.groupBy("file_path").agg(F.count("*").alias("n")).join(there, "file_path", "left")
    files = files.agg(F.count("there").alias("files"), F.count_if(F.col("there").isNull()).alias("unmatched_files"), F.sum(F.when(F.col("there") == 1, F.col("n"))).alias("known"))
    owned = fresh.join(indexed, "file_path", "left_semi").agg(F.count("*").alias("symbols"), F.sum("total_statements").alias("owned"))
    orphans = kept.join(indexed, "file_path", "left_anti").agg(F.count("*").alias("pruned_orphans"))
    lost = (F.coalesce("known", F.lit(0)) - F.coalesce("owned", F.lit(0))).alias("statements_no_symbol")
    return Ingest(after, files.crossJoin(owned).crossJoin(orphans).select("symbols", "files", "unmatched_files", lost, "pruned_orphans"), kind)


def mean_by_file(coverage: DataFrame, row: str = "_row") -> DataFrame:
    """(file_path, avg, measured): the mean percentage of each file's symbols, unmeasured ones as 0.

    A sum of doubles depends on the order of its terms, and where the mean lies between two decimals so
    does what it is rounded to. So terms are added one by one in the order of the column row, or of
    their size where there is none, however the rows are spread over tasks. The running mean of a window
    holds no file's rows at once.
    """
    share = F.coalesce("coverage_pct", F.lit(0.0).cast("double"))
    terms = coverage.select("file_path", share.alias("__share"), F.col(row if row in coverage.columns else "__share").alias("__row"))
    so_far = Window.partitionBy("file_path").orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = terms.select("file_path", F.avg("__share").over(so_far).alias("avg"), F.count("*").over(so_far).alias("n"))
    return running.groupBy("file_path").agg(F.max_by("avg", "n").alias("avg"), F.max("n").alias("measured"))


def to_decimal(x: Column) -> Column:
    """x to one decimal as SQL engines round doubles: ten times x is, not its shortest decimal form."""
    return F.round(x * 10) / 10


def per_file(coverage: DataFrame) -> DataFrame:
    """Average percentage of each file's symbols, unmeasured ones as 0, to one decimal."""
    return mean_by_file(coverage).select("file_path", to_decimal(F.col("avg")).alias("avg_coverage_pct"), F.col("measured").alias("measured_symbols"))
