"""Readers of test coverage: statement maps, LCOV records and V8 range dumps, as (file_path, line, hit_count)."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import spread


class CoverageError(ValueError):
    pass


def detect(path: str) -> str:
    """statements (JSON map), lcov or v8, by name and content of the folder."""
    if os.path.isdir(path):
        found = [k for k, p in (("statements", "coverage-final.json"), ("lcov", "lcov.info")) if os.path.exists(f"{path}/{p}")]
        if glob.glob(f"{path}/coverage-[0-9]*.json"):
            found.append("v8")
        if len(found) != 1:
            raise CoverageError(f"{path} holds {' and '.join(found) or 'no'} coverage; name one file")
        return found[0]
    if path.endswith(".info"):
        return "lcov"
    if path.endswith(".json"):
        return "statements"
    raise CoverageError(f"{path}: coverage is a .json or .info file, or a folder")


def from_statements(texts: DataFrame) -> DataFrame:
    """texts: (value) with {path: {path?, statementMap, s}}; the inner path wins, statements without a count don't count."""
    place = "struct<start:struct<line:int>>"
    shape = f"map<string,struct<path:string,statementMap:map<string,{place}>,s:map<string,bigint>>>"
    files = texts.select(F.explode(F.from_json("value", shape)).alias("key", "f"))
    rows = files.select(F.coalesce("f.path", "key").alias("file_path"), F.explode("f.statementMap").alias("id", "at"), F.col("f.s").alias("s"))
    counted = rows.withColumn("hit_count", F.try_element_at("s", F.col("id"))).where("hit_count IS NOT NULL AND at.start.line IS NOT NULL")
    return counted.select("file_path", F.col("at.start.line").alias("line"), "hit_count")


def from_lcov(texts: DataFrame) -> DataFrame:
    """texts: (value). DA lines belong to the SF before them; one outside of a record is an error."""
    parts = texts.select(F.posexplode(F.split("value", r"(?m)^[ \t]*SF:")).alias("part", "text"))  # the first is what precedes any record
    lines = parts.select("part", F.transform(F.split("text", "\r?\n"), lambda x: F.trim(x)).alias("lines"))
    ended = F.array_position("lines", "end_of_record").alias("ended")
    each = lines.select("part", F.when(F.col("part") > 0, F.get("lines", F.lit(0))).alias("file"), ended, F.posexplode("lines").alias("n", "line")).where(F.col("line").startswith("DA:"))
    orphan = F.col("file").isNull() | (F.col("file") == "") | ((F.col("ended") > 0) & (F.col("n") >= F.col("ended")))
    path = F.when(orphan, F.raise_error(F.concat(F.lit("outside of a record: "), "line")).cast("string")).otherwise(F.col("file"))
    values = F.split(F.substring("line", 4, 1 << 20), ",")
    whole = lambda i: F.when(F.trim(F.get(values, F.lit(i))).rlike("^[0-9]+$"), F.trim(F.get(values, F.lit(i))))
    rows = each.select(path.alias("file_path"), whole(0).alias("line"), whole(1).alias("hits"))
    most = F.lit((1 << 63) - 1)  # a count of more digits is a hit as any other
    hits = F.when(F.col("hits").isNotNull(), F.coalesce(F.expr("try_cast(hits AS bigint)"), most))
    return rows.select("file_path", F.expr("try_cast(line AS int)").alias("line"), hits.alias("hit_count")).where("line IS NOT NULL AND hit_count IS NOT NULL")


def line_counts(text: str, functions) -> list[tuple[int, int]]:
    """(line, count) of the lines that some range reaches into; later functions overwrite, and in one smaller ranges do."""
    starts, stops = _line_places(text)  # offsets count UTF-16 units
    count = np.zeros(len(starts), dtype=np.int64)
    seen = np.zeros(len(starts), dtype=bool)
    for f in functions:
        for r in sorted(f["ranges"], key=lambda r: r["startOffset"] - r["endOffset"]):
            first = int(np.searchsorted(stops, r["startOffset"], side="right"))  # the first line that ends behind the start
            if (at := int(np.searchsorted(starts, r["startOffset"]))) < len(starts) and starts[at] == r["startOffset"]:
                first = min(first, at)  # an empty line counts where the range begins on it
            last = max(int(np.searchsorted(starts, r["endOffset"], side="left")), first + (first < len(starts) and starts[first] == r["startOffset"]))
            count[first:last], seen[first:last] = r["count"], True
    return [(int(n) + 1, int(count[n])) for n in np.flatnonzero(seen)]


#: Lines of dumps, and of their ranges, that are painted at once; a dump with more is painted alone, range by range.
CELLS = 1 << 21


def _line_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in UTF-16 units at which lines begin and end."""
    units = np.frombuffer(text.encode("utf-16-le"), dtype=np.uint16)
    ends = np.flatnonzero(units == 10)
    return np.concatenate(([0], ends + 1)), np.append(ends, len(units))


def _runs(at: np.ndarray, count: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dump, first, last, count) of stretches of equal lines. at: where each dump's lines begin, and their end."""
    fresh = np.ones(len(count), dtype=bool)
    fresh[1:] = (count[1:] != count[:-1]) | (seen[1:] != seen[:-1])
    fresh[at[:-1]] = True
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(count))[seen[begin]]
    begin = begin[seen[begin]]
    dump = np.searchsorted(at, begin, side="right") - 1
    return dump, begin - at[dump] + 1, end - at[dump], count[begin]


def _paint(texts: list[tuple[np.ndarray, np.ndarray]], text: np.ndarray, dump: np.ndarray, function: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray):
    """As line_counts(), for ranges of many dumps at once, as _runs(). text: of each dump, the place of its lines in texts."""
    length = np.array([len(a) for a, _ in texts])
    base = np.concatenate(([0], np.cumsum(length)))
    far = np.repeat(np.arange(len(texts), dtype=np.int64) << 33, length)  # one text lies behind the other
    starts, stops = far + np.concatenate([a for a, _ in texts]), far + np.concatenate([b for _, b in texts])
    order = np.lexsort((begin - end, function))
    dump, begin, end, count = dump[order], begin[order], end[order], count[order]
    of = text[dump]
    lines, zero = length[of], base[of]
    a, b = (of << 33) + np.maximum(begin, -1), (of << 33) + np.maximum(end, -1)
    first = np.searchsorted(stops, a, side="right") - zero
    at = np.searchsorted(starts, a) - zero
    on = (at < lines) & (starts[zero + np.minimum(at, lines - 1)] == a)
    first = np.where(on, np.minimum(first, at), first)
    on = (first < lines) & (starts[zero + np.minimum(first, lines - 1)] == a)
    last = np.maximum(np.searchsorted(starts, b) - zero, first + on)
    cells = np.concatenate(([0], np.cumsum(length[text])))
    winner = np.zeros(cells[-1], dtype=np.int64)
    span = np.maximum(np.minimum(last, lines) - first, 0)
    if len(text) == 1 and span.sum() > CELLS:
        for k in np.flatnonzero(span):
            winner[first[k] : first[k] + span[k]] = k + 1
    else:
        where = np.repeat(cells[dump] + first - np.cumsum(span) + span, span) + np.arange(span.sum())
        np.maximum.at(winner, where, np.repeat(np.arange(1, len(span) + 1), span))
    return _runs(cells, np.append(0, count)[winner], winner > 0)


def _batch_runs(urls: list[str], ranges: pa.Array, read_source) -> Iterator[pa.RecordBatch]:
    """Rows of runs for the scripts of a batch; each source is read once."""
    functions, inner = np.asarray(ranges.offsets).astype(np.int64), ranges.values
    bounds = np.asarray(inner.offsets).astype(np.int64)
    if len(inner) == 0:
        return
    fields = [inner.values.field(k) for k in range(3)]
    if any(f.null_count for f in fields):
        raise CoverageError("a range lacks an offset or its count")
    begin, end, count = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)
    by_path: dict[str, list[int]] = {}
    for k, url in enumerate(urls):
        by_path.setdefault(url.removeprefix("file://"), []).append(k)
    texts: list = []
    chunk: list[tuple[int, str, int]] = []  # (place in texts, path, script)
    cells = 0

    def painted() -> pa.RecordBatch:
        own = np.array([k for _, _, k in chunk])
        low, high = bounds[functions[own]], bounds[functions[own + 1]]
        some = high - low
        pick = np.repeat(low - np.cumsum(some) + some, some) + np.arange(some.sum())
        function = np.searchsorted(bounds, pick, side="right")
        # functions are painted in the order of their scripts in the chunk, which need not be that of the batch
        dump = np.repeat(np.arange(len(own)), some)
        rank = np.concatenate(([0], np.cumsum((np.diff(function) != 0) | (np.diff(dump) != 0)))) if len(pick) else pick
        of, first, last, hits = _paint(texts, np.array([t for t, _, _ in chunk]), dump, rank, begin[pick], end[pick], count[pick])
        paths = pa.array([p for _, p, _ in chunk], pa.string()).take(pa.array(of))
        return pa.RecordBatch.from_arrays([paths, pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(hits, pa.int64())], names=["file_path", "first", "last", "hit_count"])

    before = None
    for path, scripts in by_path.items():
        text = read_source(path)
        if text is None:
            continue
        if text != before:
            places, before = _line_places(text), text
        fresh = True
        for k in scripts:
            low, high = bounds[functions[k]], bounds[functions[k + 1]]
            if low == high:
                continue
            more = len(places[0]) * int(high - low + 1)
            if chunk and cells + more > CELLS:
                yield painted()
                texts, chunk, cells, fresh = [], [], 0, True
            if fresh:
                texts.append(places)
                fresh = False
            chunk.append((len(texts) - 1, path, k))
            cells += more
    if chunk:
        yield painted()


def from_v8(texts: DataFrame, read_source) -> DataFrame:
    """texts: (value) dumps. read_source(path) gives the text that offsets refer to, or None.

    In a script later functions overwrite earlier ones, and in a function smaller ranges larger ones;
    across processes the greatest count of a line stands. Dumps are spread over tasks before they are
    read, painted many at a time, and leave Python as stretches of lines with one count.
    """
    shape = "struct<result:array<struct<url:string,functions:array<struct<functionName:string,ranges:array<struct<startOffset:int,endOffset:int,count:bigint>>>>>>>"
    scripts = spread(texts, "value").select(F.explode(F.from_json("value", shape)["result"]).alias("r")).where(F.col("r.url").startswith("file://"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            yield from _batch_runs(p.column(0).to_pylist(), p.column(1), read_source)

    flat = scripts.select(F.col("r.url").alias("url"), F.col("r.functions.ranges").alias("ranges"))
    runs = flat.mapInArrow(run, "file_path string, first int, last int, hit_count bigint")
    return runs.select("file_path", F.explode(F.sequence("first", "last")).alias("line"), "hit_count").groupBy("file_path", "line").agg(F.max("hit_count").alias("hit_count"))


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def read(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, str]:
    """(rows, format) of a coverage artifact."""
    kind = kind or detect(path)
    if os.path.isdir(path):
        path += {"statements": "/coverage-final.json", "lcov": "/lcov.info", "v8": "/coverage-*.json"}[kind]
    texts = spark.read.text(path, wholetext=True)
    return {"statements": from_statements, "lcov": from_lcov, "v8": lambda t: from_v8(t, _read)}[kind](texts), kind
