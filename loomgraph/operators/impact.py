"""Impact: who is reached from a symbol or file over calls, dependencies and imports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut

UNBOUNDED, DEFAULT_DEPTH, DEFAULT_LIMIT = 1_000_000, 3, 500


#: Up to so many bytes of node names a frontier is sent to the edges; beyond that both are shuffled.
SENT_BYTES = 16 << 20


def walk(edges: DataFrame, seeds: DataFrame, depth: int = DEFAULT_DEPTH, limit: int | None = None) -> DataFrame:
    """(node, depth): the nodes within depth steps of the seeds, each at its least depth; seeds aren't among them.

    edges: (src, dst). seeds: (node). Breadth first: each level joins the frontier with the edges and
    drops what was seen. The distance is that of the shortest path, so cycles need no further guard.
    A level is written to the shared folder before the next begins, and its size decides how it meets
    the edges: while it is small the edges are scanned where they are. With a limit, no level is begun
    once that many nodes are found.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    seen = frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    near, all_ = _bytes(frontier), 0
    total, level = 0, 0
    while level < (depth or UNBOUNDED):
        level += 1
        all_ += near[1]
        front = frontier.select(F.col("node").alias("src"))
        step = edges.join(F.broadcast(front) if near[1] <= SENT_BYTES else front, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        known = seen.select("node")
        fresh = step.join(F.broadcast(known) if all_ <= SENT_BYTES else known, "node", "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(level)))
        near = _bytes(frontier)
        if not near[0]:
            break
        total += near[0]
        seen = seen.unionByName(frontier)
        if limit is not None and total > limit:
            break
    return seen.where("depth > 0")


def _bytes(nodes: DataFrame) -> tuple[int, int]:
    """Nodes, and the bytes that they take."""
    count, size = nodes.agg(F.count("*"), F.sum(F.octet_length(F.col("node").cast("string")) + 16)).first()
    return count, size or 0


def backends(kind: str, via: str = "all") -> tuple[list[str], list[dict]]:
    """The graphs for a target of a kind (file or symbol), and those asked for that don't fit it."""
    fitting = ["dependencies", "imports"] if kind == "file" else ["calls"]
    asked = fitting if via == "all" else [via]
    reason = "needs a symbol, and the target is a file" if kind == "file" else "needs a file, and the target is a symbol"
    return [b for b in asked if b in fitting], [{"backend": b, "reason": reason} for b in asked if b not in fitting]


def graph(tables, backend: str, direction: str) -> DataFrame:
    """(src, dst) such that a step leads in the direction: down to what is used, up to users."""
    if backend == "calls":
        edges = tables.calls.select(F.col("caller_name").alias("src"), F.col("callee_name").alias("dst"))
    elif backend == "dependencies":
        edges = tables.dependencies.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"))
    else:
        edges = tables.imports.where("resolved_path IS NOT NULL").select(F.col("file_path").alias("src"), F.col("resolved_path").alias("dst"))
    return edges if direction == "down" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@dataclass
class Impact:
    target: dict
    direction: str
    via: list[str]
    depth_limit: int
    matches: DataFrame
    summary: dict
    skipped_backends: list[dict] = field(default_factory=list)


def resolve_target(tables, target: str) -> dict:
    """A file if the name has a slash or is an indexed path; else a symbol with the files that declare it."""
    if "/" in target or "\\" in target or not tables.files.where(F.col("path") == target).isEmpty():
        return {"kind": "file", "name": target, "files": [target]}
    files = tables.symbols.where(F.col("name") == target).select("file_path").distinct().orderBy("file_path")
    return {"kind": "symbol", "name": target, "files": [r[0] for r in files.toLocalIterator()]}


def matches(tables, target: dict, direction: str = "both", via: str = "all", depth: int = DEFAULT_DEPTH, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(depth, direction, edge, kind, name, file_path), each node once for a direction, at its least depth; not cut off."""
    spark = tables.spark
    seeds = spark.createDataFrame([(target["name"],)], "node string")
    chosen, _ = backends(target["kind"], via)
    out = spark.createDataFrame([], "depth int, direction string, edge string, kind string, name string, file_path string, rank int")
    for way in ("down", "up") if direction == "both" else (direction,):
        for rank, backend in enumerate(chosen):
            edges = graph(tables, backend, way)
            found = walk(edges, seeds, depth, limit)
            edge = {"calls": ("calls", "called_by"), "dependencies": ("depends_on", "depended_on_by"), "imports": ("imports", "imported_by")}[backend][way == "up"]
            if backend == "calls":
                places = tables.symbols.groupBy(F.col("name").alias("node")).agg(F.min("file_path").alias("file_path"))
                found = found.join(places, "node", "left").withColumn("file_path", F.coalesce("file_path", F.lit("")))
                kind, name = "symbol", F.col("node")
            else:
                found = found.withColumn("file_path", F.col("node"))
                kind, name = "file", F.lit(None).cast("string")
            out = out.unionByName(found.select(F.col("depth").cast("int"), F.lit(way).alias("direction"), F.lit(edge).alias("edge"), F.lit(kind).alias("kind"), name.alias("name"), "file_path", F.lit(rank).alias("rank")))
    first = Window.partitionBy("direction", "kind", "name", "file_path").orderBy("depth", "rank")
    return out.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "rank")


def find_impact(tables, target: str, direction: str = "both", via: str = "all", depth: int = DEFAULT_DEPTH, limit: int = DEFAULT_LIMIT) -> Impact:
    """The impact of a symbol or file. depth 0 means no bound; limit caps the matches that are returned."""
    goal = resolve_target(tables, target)
    chosen, skipped = backends(goal["kind"], via)
    found = cut(matches(tables, goal, direction, via, depth, limit))
    nodes, deepest = found.agg(F.count("*"), F.max("depth")).first()
    kept = found.orderBy("depth", "direction", "edge", F.col("file_path"), F.col("name").asc_nulls_first())
    if nodes > limit:  # else a sort, as the top of a great limit takes memory for all of it
        kept = kept.limit(limit)
    kinds = {r["kind"]: r["count"] for r in kept.groupBy("kind").count().collect()}
    if nodes > limit:
        ended = "limit"
    else:
        ended = "depth" if depth and (deepest or 0) >= depth else "exhausted"
    summary = {"nodes": min(nodes, limit), "max_depth_reached": deepest or 0, "by_kind": kinds, "terminated_by": ended}
    return Impact(goal, direction, chosen, depth, kept, summary, skipped)
