"""Small tests of the findings of round 3."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import coverage
from loomgraph.schema import Tables
from loomgraph.sources import coverage_files, scan

_SHAPE = "file_path string, name string, line_start int, coverage_pct double, hit_statements bigint, total_statements bigint"


def test_mean_of_a_file_is_added_in_the_order_of_its_rows(spark):
    """Of 20.83..., 16 and 10.41... the mean is 15.75 or just below it, as they are added."""
    terms = [20.833333333333332, 16.0, 10.416666666666666]
    for order, want in (((0, 1, 2), 15.7), ((0, 2, 1), 15.8)):
        rows = [("a", "f", place, terms[k], 1, 1) for place, k in enumerate(order)]
        for parts in (rows, rows[::-1]):
            table = spark.createDataFrame(parts, _SHAPE).repartition(3, "line_start").withColumn("_row", F.col("line_start"))
            assert [tuple(r) for r in coverage.per_file(table).collect()] == [("a", want, 3)]


def test_means_are_rounded_as_sql_rounds_doubles(spark):
    """Ten times this is 4.5, which goes up."""
    table = spark.createDataFrame([("a", "f", 1, 0.44999999999999996, 1, 1)], _SHAPE)
    assert coverage.per_file(table).first()[1] == 0.5


def test_files_of_one_piece_are_parsed_by_several_tasks(spark):
    files = spark.range(64, numPartitions=1).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("path"), F.encode(F.lit("const a = 1;\n"), "utf-8").alias("content"), F.lit(0).alias("modified"))
    parsed = scan.parse_texts(files, tables=("symbols",))
    assert parsed.select(F.spark_partition_id()).distinct().count() > 4  # though they are few bytes
    assert "symbols" in parsed.columns and "calls" not in parsed.columns
    assert {r[0] for r in scan.explode_tables(parsed)["symbols"].select("name").collect()} == {"a"}


def _ingest(spark):
    files = spark.createDataFrame([("a.ts",), ("b.ts",)], "path string")
    symbols = spark.createDataFrame([(1, "a.ts", "f", 1, 5), (2, "gone.ts", "g", 1, 5)], "id bigint, file_path string, name string, line_start int, line_end int")
    old = spark.createDataFrame([("a.ts", "old", 1, 0.0, 0, 1), ("b.ts", "kept", 1, 50.0, 1, 2), ("left.ts", "x", 1, 0.0, 0, 1)], _SHAPE)
    rows = spark.createDataFrame([("/r/a.ts", 2, 1), ("./a.ts", 3, 0), (".\\a.ts", 9, 1), ("gone.ts", 2, 1)], "file_path string, line int, hit_count bigint")
    return Tables(spark, {"files": files, "symbols": symbols, "coverage": old}), rows


def test_an_ingest_runs_no_job_before_it_is_asked(spark):
    t, rows = _ingest(spark)
    spark.sparkContext.setJobGroup("ingest", "ingest")
    try:
        done = coverage.upsert(t, rows, "/r", "lcov")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("ingest")
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_an_ingest_replaces_prunes_and_counts(spark):
    done = coverage.upsert(*_ingest(spark), "/r", "lcov")
    assert sorted(map(tuple, done.coverage.collect())) == [("a.ts", "f", 1, 50.0, 1, 2), ("b.ts", "kept", 1, 50.0, 1, 2)]
    assert (done.symbols, done.files, done.unmatched_files, done.statements_no_symbol, done.pruned_orphans, done.format) == (1, 1, 1, 1, 1, "lcov")


def test_paths_of_coverage_are_made_relative(spark):
    given = ["/r.x/a/b.ts", "./././r.x/a.ts", ".//r.x/c.ts", "./.\\d.ts", "/r.xy/e.ts", "../f.ts", "/r.x/../g.ts", "/r.x/", "", "\n", "/rzx/h.ts", "r/./i.ts", "/r.x//r.x/j.ts", "C:\\k.ts"]
    rows = spark.createDataFrame([(p, 1, 1) for p in given], "file_path string, line int, hit_count int")
    got = [r[0] for r in coverage.normalise(rows, "/r.x/").select("file_path").collect()]
    assert sorted(got) == sorted(["a/b.ts", "r.x/a.ts", "c.ts", "d.ts", "\n", "r/./i.ts", "C:/k.ts"])


@pytest.mark.parametrize("cells", [1 << 21, 300, 1])
def test_dumps_painted_many_at_a_time_equal_those_one_by_one(monkeypatch, cells):
    monkeypatch.setattr(coverage_files, "CELLS", cells)
    rng = random.Random(cells)
    kind = pa.list_(pa.list_(pa.struct([("startOffset", pa.int32()), ("endOffset", pa.int32()), ("count", pa.int64())])))
    for _ in range(100):
        texts = {f"/p{k}": "".join(rng.choice("ab\n\né😀") for _ in range(rng.choice((0, 1, 5, 30)))) for k in range(4)} | {"/none": None}
        urls = ["file://" + rng.choice(list(texts)) for _ in range(rng.randint(0, 8))]
        some = lambda: [{"startOffset": rng.randint(-2, 40), "endOffset": rng.randint(-2, 45), "count": rng.randint(0, 3)} for _ in range(rng.randint(0, 4))]
        functions = [[some() for _ in range(rng.randint(0, 3))] for _ in urls]
        want = [(u[7:], *x) for u, f in zip(urls, functions) if texts[u[7:]] is not None for x in coverage_files.line_counts(texts[u[7:]], [{"ranges": r} for r in f])]
        runs = [r for b in coverage_files._batch_runs(urls, pa.array(functions, kind), texts.get) for r in b.to_pylist()]
        assert sorted((r["file_path"], n, r["hit_count"]) for r in runs for n in range(r["first"], r["last"] + 1)) == sorted(want)


def test_a_source_is_read_once_for_all_its_dumps_of_a_batch_and_dumps_are_spread(spark):
    dump = lambda k: '{"result":[{"url":"file:///a.js","functions":[{"functionName":"f","ranges":[{"startOffset":0,"endOffset":3,"count":%d}]}]}]}' % k
    dumps = spark.createDataFrame([(dump(k),) for k in range(64)], "value string").coalesce(1)
    reads, tasks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def source(path):
        from pyspark import TaskContext

        reads.add(1)
        tasks.add(1 << TaskContext.get().partitionId())
        return "x\ny\nz"

    got = sorted(map(tuple, coverage_files.from_v8(dumps, source).collect()))
    assert got == [("/a.js", 1, 63), ("/a.js", 2, 63)]
    assert 4 < reads.value <= 16 and reads.value == tasks.value.bit_count()
