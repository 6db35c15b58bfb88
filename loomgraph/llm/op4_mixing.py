"""Mixing sources to target weights by entropy balancing.

Documents get the rates w nearest to 1 (in relative entropy) under which the tokens of each source
sum to its target. The dual is convex, with one multiplier for each source, and its solution tilts
the rates exponentially: w = exp(lambda_source * tokens / scale). Newton's method solves it: each
iteration is one distributed aggregation of g = sum(w t), h = sum(w t t) over the table (source,
tokens, documents), which is made once and is all that the rates depend on. The step (goal - g) / h is
damped to log(goal / g) g / h, which is Newton's step for the logarithm of g: that is convex in the
multiplier and nearly straight, so steps don't overshoot and few are needed however far the target.
Should ITERATIONS not do, that is an error and not a rate off its target. Rates become copies: the whole
part, and one more if a hash of the document falls below the fraction, so that each document's
expected copies are its rate and the decision is the same on every run.

The target weights are given by source, or follow from the corpus as its token shares to the power
of FLATTEN. Without a total, the total is the least for which no source must shrink: then each rate
is 1 at least and no document is lost.

Tokens are counted as runs of characters other than white space.

Cases: a null source is a source of its own. A null text, or one without tokens, weighs nothing; it
keeps rate 1 and its one copy. A null doc_id is hashed as the empty string. Repeated rows count as
often as they occur, and get the same number of copies each; rows of one doc_id but other text are
rounded by the same hash. A source with a target but no tokens can't meet it and is left out of the
shares. With given weights, a source that they lack, or of weight 0, gets no copies. An empty table
gives an empty result. `copies` returns three columns whatever df has; `mix` returns the columns of
df in their order, and further columns have no effect, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, digest_int, named, store

FLATTEN = 0.8
TOLERANCE = 1e-9
ITERATIONS = 500
#: Up to so many sources their multipliers are constants of the plan; with more they are a table and are joined.
FEW = 2000
#: Parts that the rows of a source are split into for that join.
SALTS = 32
#: Rates are rounded by a hash in this many steps.
STEPS = 1 << 30


def tokens_of(text: Column) -> Column:
    """The number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\x0b\x0c]+")), F.lit(0)).cast("long")


def targets(cells: DataFrame, weights: dict | None = None, total: float | None = None, flatten: float = FLATTEN) -> tuple[DataFrame, float]:
    """(source, t, n, a, b, goal) with tokens and documents now, least and greatest document, and the tokens wanted; the mean document.

    cells: (source, tokens, documents) with positive tokens.
    """
    per = cells.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("documents")).alias("t"), F.sum("documents").alias("n"), F.min("tokens").alias("a"), F.max("tokens").alias("b")
    )
    whole, documents = per.agg(F.sum("t"), F.sum("n")).first()
    if weights is None:
        per = per.withColumn("weight", F.pow(F.col("t") / F.lit(float(whole or 1)), F.lit(float(flatten))))
    else:
        given = [("null" if s is None else f"={s}", float(w)) for s, w in weights.items()]
        known = cells.sparkSession.createDataFrame(given, "source string, weight double")
        per = per.join(known, "source", "left").na.fill(0.0, ["weight"])
    per = store(per)
    norm, least = per.agg(F.sum("weight"), F.max(F.when(F.col("weight") > 0, F.col("t") / F.col("weight")))).first()
    if total is None:
        total = (least or 0.0) * (norm or 0.0)
    goal = F.lit(float(total) / norm) * F.col("weight") if norm else F.lit(0.0)
    return per.select("source", "t", "n", "a", "b", goal.alias("goal")), (whole or 0) / max(1, documents or 0) or 1.0


def multipliers(cells: DataFrame, goals: DataFrame, scale: float, few: bool, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, lam) for each source with a positive goal. few: there are at most FEW sources, so a step's result may pass through the driver."""
    spark = cells.sparkSession
    x, lam = F.col("tokens") / F.lit(scale), F.col("lam")
    open_ = goals.where("goal > 0").select("source", F.log(F.col("goal") / F.lit(scale)).alias("goal"), (F.col("a") / F.lit(scale)).alias("a"), (F.col("b") / F.lit(scale)).alias("b"), F.lit(0.0).alias("lam"))
    found = []
    for _ in range(ITERATIONS):
        top = F.greatest(lam * F.col("a"), lam * F.col("b"))  # the greatest exponent, taken out so that nothing overflows
        w = F.col("documents") * x * F.exp(lam * x - top)
        sums = cells.join(F.broadcast(open_) if few else open_, "source").groupBy("source", "goal", "a", "b", "lam").agg(F.sum(w).alias("g"), F.sum(w * x).alias("h"))
        gap = F.log("g") + top - F.col("goal")
        step = lam - gap * F.col("g") / F.col("h")
        done = (F.abs(gap) <= tolerance) | (step == lam)
        moved = sums.select("source", "goal", "a", "b", F.when(done, lam).otherwise(step).alias("lam"), done.alias("done"))
        moved = spark.createDataFrame(moved.collect(), moved.schema) if few else cut(moved)
        found.append(moved.where("done").select("source", "lam"))
        open_ = moved.where("NOT done").drop("done")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
    raise RuntimeError(f"no multipliers found in {ITERATIONS} steps for {open_.count()} sources")


def copies(df: DataFrame, weights: dict | None = None, total: float | None = None, flatten: float = FLATTEN, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, rate, copies) for each row of df."""
    rows = _rated(df.select(named(id_col).alias("doc_id"), named(source_col).alias("source"), named(text_col).alias("text")), "doc_id", "text", "source", weights, total, flatten)
    return rows.select(F.col("row.doc_id").alias("doc_id"), "rate", _count(F.col("row.doc_id"), F.col("rate")).alias("copies"))


def mix(df: DataFrame, weights: dict | None = None, total: float | None = None, flatten: float = FLATTEN, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row of df as often as its copies say."""
    rows = _rated(df, id_col, text_col, source_col, weights, total, flatten)
    counted = rows.select("row", _count(F.col("row").getField(id_col), F.col("rate")).alias("n"))
    each = F.when(F.col("n") > 0, F.sequence(F.lit(1).cast("bigint"), "n"))  # no filter, for which all this would be computed once more
    return counted.select("row", F.explode(each)).select("row.*")


def _count(doc_id: Column, rate: Column) -> Column:
    """The copies of a document."""
    part = digest_int(F.coalesce(doc_id.cast("string"), F.lit(""))) % STEPS / F.lit(float(STEPS))
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def _rated(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: dict | None, total: float | None, flatten: float) -> DataFrame:
    """(row, rate) for each row of df; in a struct no name can clash."""
    source = F.coalesce(F.concat(F.lit("="), named(source_col).cast("string")), F.lit("null"))
    tokens = tokens_of(named(text_col))
    cells = store(df.select(source.alias("source"), tokens.alias("tokens")).where("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("documents")))
    goals, scale = targets(cells, weights, total, flatten)
    few = goals.count() <= FEW
    lam = multipliers(cells, goals, scale, few)
    rows = df.select(F.struct(*map(named, df.columns)).alias("row"), source.alias("source"), tokens.alias("tokens"))
    if few:  # a constant of the plan
        pairs = [F.lit(x) for r in lam.collect() for x in (r["source"], float(r["lam"]))]
        rows = rows.withColumn("lam", F.create_map(*pairs)[F.col("source")] if pairs else F.lit(None).cast("double"))
    else:  # a join, in which each source is spread over SALTS keys
        salted = lam.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(salted, ["source", "salt"], "left")
    rate = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.coalesce(F.exp(F.col("lam") * F.col("tokens") / F.lit(scale)), F.lit(0.0)))
    return rows.select("row", rate.alias("rate"))
